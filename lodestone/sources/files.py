"""Files as a table, scanned once and shared by every extractor; and the state that is kept beside them."""

from __future__ import annotations

import re
import subprocess
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relational import first_wins, ignored
from lodestone.shared import shared_dir

IGNORED = ("node_modules", "dist", "build", "target", ".git", "vendor", "__pycache__", ".venv", "coverage")


def scan(spark: SparkSession, root: str, suffixes: Sequence[str] = (), ignore: Sequence[str] = IGNORED) -> DataFrame:
    """(path, content, mtime, size) of the files under root (S1): one distributed listing and read, paths below root.

    Content is text in UTF-8; the suffix filter is on the listing, so other files are never opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    found = _as_text(reader.load(root), root)
    return found.where(~ignored(F.col("path"), ignore))


def rescan(spark: SparkSession, root: str, before: DataFrame, most: int = 10_000) -> DataFrame:
    """The files under root as scan gives them, of which only those with another size or time than before are read (M7).

    The listing alone, made once, is compared with before, a scan's result; the rest comes from there. If more than
    most files changed, everything is read again, as their names then make too long a list for the reader.
    """
    kept = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"  # a file saved between two listings would be in neither half
    scan(spark, root).select("path", "mtime", "size").hint("rebalance", "path").write.parquet(kept)
    now = spark.read.schema("path string, mtime timestamp, size bigint").parquet(kept)
    known = before.select("path", "mtime", "size")
    changed = [r["path"] for r in now.join(known, ["path", "mtime", "size"], "left_anti").select("path").limit(most + 1).collect()]
    if len(changed) > most:
        return scan(spark, root)
    same = before.join(now, ["path", "mtime", "size"], "left_semi").select("path", "content", "mtime", "size")
    return same.unionByName(read_some(spark, root, changed)) if changed else same


def read_some(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """The named files under root as scan gives them; one that is not there raises."""
    return _read(spark, root, [f"{root.rstrip('/')}/{p}" for p in paths])


def _read(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    escaped = [re.sub(r"([\\*?\[\]{}])", r"\\\1", n) for n in names]
    found = spark.read.format("binaryFile").load(escaped)
    return _as_text(found, root)


def _as_text(found: DataFrame, root: str) -> DataFrame:
    base = re.sub(r"^[a-z0-9]+:/*", "", root).strip("/")
    relative = F.regexp_replace(F.col("path"), F.lit(r"^(?:[a-z0-9]+:)?/*\Q" + base + r"\E/"), F.lit(""))
    return found.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of the files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def tracked(files: DataFrame, units: DataFrame, unit_path: str, unit: str) -> DataFrame:
    """(unit, path, sha256) of every file under every unit that holds it (F8)."""
    from lodestone.operators.relational import prefix_join

    rooted = hashes(files).withColumn("_at", F.concat(F.lit("/"), "path"))
    places = units.select(F.col(unit).alias("unit"), F.concat(F.lit("/"), F.col(unit_path)).alias("_unit"))
    return prefix_join(rooted, "_at", places, "_unit").select("unit", "path", "sha256")


def extract(files: DataFrame, parse: Callable[[str, str], list[tuple]], schema: str, containing: Sequence[str] = (), suffixes: Sequence[str] = (), errors: bool = False) -> DataFrame:
    """Rows that parse(path, content) finds, file by file; one file's failure costs only that file's rows.

    The tests by suffix and substring run in the JVM before the content goes to Python. With errors the result is
    (file, error) of the files that parse could not read instead (U1, M6).
    """
    for_python = files.where(F.col("content").isNotNull())
    if suffixes:
        for_python = for_python.where(_any([F.endswith("path", F.lit(s)) for s in suffixes]))
    if containing:
        for_python = for_python.where(_any([F.contains("content", F.lit(c)) for c in containing]))
    schema = "file string, error string" if errors else schema
    arrow = _arrow(files.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = parse(path, content)
                    out += [] if errors else found
                except (ValueError, IndexError, KeyError, RecursionError) as e:
                    if errors:
                        out.append((path, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], arrow)

    return for_python.select("path", "content").mapInArrow(run, schema)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def maven_modules(files: DataFrame, repo_slug: str | None = None) -> DataFrame:
    """A module for each directory with a pom.xml (S2); the slug is its last segment in lower case, the root's is "root"."""
    pom = files.where((F.col("path") == "pom.xml") | F.endswith("path", F.lit("/pom.xml")))
    at = F.regexp_replace("path", "/?pom\\.xml$", "")
    name = F.when(at == "", "root").otherwise(F.element_at(F.split(at, "/"), -1))
    return pom.select(F.lower(name).alias("slug"), name.alias("name"), at.alias("path"), F.lit(repo_slug).cast("string").alias("repo_slug"))


def state(spark: SparkSession, path: str, schema: str, version: int | None = None) -> tuple[DataFrame, str | None]:
    """A JSON state table and a note (S25, P14): a missing, corrupt or older file is an empty table with a note."""
    full = f"{schema}, _corrupt string"
    empty = spark.createDataFrame([], schema)
    try:
        df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).persist()
        if df.where("_corrupt IS NOT NULL").count():
            return empty, "index corrupt, run the scan again"
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty, "index not built"
        raise
    if version is not None and df.where(F.col("version") == version).isEmpty():
        return empty, "index of another version"
    return df.drop("_corrupt"), None


def git_changed(spark: SparkSession, root: str, since: str, run=subprocess.run) -> DataFrame:
    """(path) of files changed since a commit (S29); the command's failure raises, and the caller scans all."""
    done = run(["git", "-C", root, "diff", "--name-only", f"{since}..HEAD"], capture_output=True, text=True, check=True)
    return spark.createDataFrame([(p,) for p in done.stdout.splitlines() if p], "path string")


MARKERS = (("pom.xml", "java"), ("build.gradle", "java"), ("go.mod", "go"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("package.json", "ts"))


def workspace(files: DataFrame) -> DataFrame:
    """(repo, lang, slug) of each top directory with a marker file (S31); java before go before python before ts."""
    name = F.element_at(F.split("path", "/"), -1)
    ranks = F.create_map(*(x for i, (m, lang) in enumerate(MARKERS) for x in (F.lit(m), F.struct(F.lit(i).alias("rank"), F.lit(lang).alias("lang")))))
    hit = files.where(F.size(F.split("path", "/")) == 2).select(F.substring_index("path", "/", 1).alias("repo"), F.element_at(ranks, name).alias("m")).where("m IS NOT NULL")
    from lodestone.functions.text import slug

    return first_wins(hit.select("repo", "m.rank", "m.lang"), ["repo"], ["rank", "lang"]).select("repo", "lang", slug(F.col("repo")).alias("slug"))


def init_workspace(files: DataFrame, store) -> DataFrame:
    """Writes the table workspace of workspace(files) if it is new or changed, and returns it."""
    store.write_if_changed("workspace", workspace(files).orderBy("repo"))
    return store.read("workspace")


PACKAGE = "name string, private boolean, workspaces string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
FRAMEWORKS = (("vue", "vue"), ("nuxt", "vue"), ("react", "react"), ("next", "react"), ("svelte", "svelte"), ("@angular/core", "angular"))


def packages(files: DataFrame) -> DataFrame:
    """(slug, name, path, framework) of frontend packages.

    Those that the globs of pnpm-workspace.yaml name, else those of the root package.json's workspaces (a list, or an
    object's packages); without globs the root package if it has a name, else direct children with a name and a
    framework. A glob's * is one folder, ** one or more of them; a leading ! excludes.
    """
    from lodestone.functions.text import slug_each

    parsed = files.where((F.col("path") == "package.json") | F.endswith("path", F.lit("/package.json"))).select(F.regexp_replace("path", "/?package\\.json$", "").alias("path"), F.from_json("content", PACKAGE).alias("p"))
    none_at = F.array().cast("array<string>")
    all_names = F.flatten(F.array(*(F.coalesce(F.map_keys(f"p.{d}"), none_at) for d in ("dependencies", "devDependencies", "peerDependencies"))))
    framework = None
    for dep, name in FRAMEWORKS:
        hit = F.array_contains(all_names, dep)
        framework = F.when(hit, name) if framework is None else framework.when(hit, name)
    every = parsed.where("p.name IS NOT NULL").select("path", "p.name", framework.alias("framework"))
    pnpm = files.where("path IN ('pnpm-workspace.yaml', 'pnpm-workspace.yml')").select(F.regexp_extract_all("content", F.lit(r"(?m)^\s*-\s*[\"']?([^\"'#\n]+?)[\"']?\s*(?:#.*)?$"), 1).alias("globs"))
    listed = F.coalesce(F.from_json("p.workspaces", "array<string>"), F.from_json("p.workspaces", "packages array<string>")["packages"])
    npm = parsed.where("path = ''").select(listed.alias("globs"))
    said = pnpm.select("globs", F.lit(0).alias("rank")).unionByName(npm.select("globs", F.lit(1).alias("rank"))).where("size(globs) > 0")
    globs = said.orderBy("rank").limit(1)  # two rows at most
    bare = F.transform(F.filter("globs", lambda g: ~F.startswith(g, F.lit("!"))), _glob)
    barred = F.transform(F.filter("globs", lambda g: F.startswith(g, F.lit("!"))), lambda g: _glob(F.substr(g, F.lit(2))))
    matched = every.crossJoin(F.broadcast(globs.select(bare.alias("_in"), barred.alias("_out")))).where(F.exists("_in", lambda g: F.rlike("path", g)) & ~F.exists("_out", lambda g: F.rlike("path", g))).drop("_in", "_out")
    none = globs.agg((F.count("*") == 0).alias("_none"), F.lit(1).alias("_one"))
    root = every.where("path = ''")
    children = every.where(~F.contains("path", F.lit("/")) & (F.col("path") != "") & F.col("framework").isNotNull() & ~F.startswith("path", F.lit(".")))
    no_root = root.agg((F.count("*") == 0).alias("_rootless"))
    lone = root.crossJoin(none).where("_none").drop("_none", "_one")
    child = children.crossJoin(none).crossJoin(no_root).where("_none AND _rootless").drop("_none", "_one", "_rootless")
    return matched.unionByName(lone).unionByName(child).select(slug_each(F.col("name")).alias("slug"), "name", "path", "framework")


def _glob(g: Column) -> Column:
    """A package glob as a regular expression over folders, segment by segment."""
    segment = lambda x: F.when(x == "**", F.lit(".+")).otherwise(F.regexp_replace(F.regexp_replace(x, r"([.+()^$|\[\]{}?])", r"\\$1"), r"\*", "[^/]*"))
    parts = F.split(F.regexp_replace(F.trim(g), r"^\./|/+$", ""), "/")
    return F.concat(F.lit("^"), F.array_join(F.transform(parts, segment), "/"), F.lit("$"))


def http_files(spark: SparkSession, urls: Sequence[str], fetch: Callable[[str], str]) -> DataFrame:
    """(path, content) of what fetch gives for each URL (S30), read by the executors: a live source as a table of files.

    A URL whose fetch raises OSError has null content. fetch holds the address, the token and the waiting.
    """
    df = spark.createDataFrame([(u,) for u in urls], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                try:
                    out.append(fetch(url))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "content"])

    return df.mapInArrow(run, "path string, content string")
