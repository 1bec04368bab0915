"""Design sources: style tokens, components and page recipes from several tools, as the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import relational as R

PAGE_TYPES = (
    ("(?i)login|sign-?in|password", "auth"),
    ("(?i)<table|<Table|DataTable|columns=", "list"),
    ("(?i)<form|<Form|useForm", "form"),
    ("(?i)chart|dashboard|<Stat", "dashboard"),
    ("(?i)settings|preferences", "settings"),
)


def page_type(tsx: Column) -> Column:
    """The kind of page a component renders; the first heuristic counts."""
    return T.ordered_bucket(tsx, PAGE_TYPES, "detail")


def css_tokens(files: DataFrame) -> DataFrame:
    """(name, value, bucket, file) of the custom properties of all style sheets; the last file by path wins."""
    css = files.where(F.endswith("path", F.lit(".css"))).select(F.col("path").alias("file"), F.explode(T.css_properties(F.col("content"))).alias("name", "value"))
    last = R.last_wins(css, ["name"], ["file"])
    return last.select("name", "value", T.ordered_bucket(F.regexp_replace("name", "^--", ""), T.TOKEN_BUCKETS).alias("bucket"), "file")


def inline_imports(files: DataFrame) -> DataFrame:
    """(path, content): style sheets with the sheets they import in front, one level."""
    css = files.where(F.endswith("path", F.lit(".css"))).select("path", "content")
    wanted = css.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"@import\s+(?:url\()?[\"']\.?/?([^\"')]+)[\"']\)?\s*;"), 1)).alias("n", "name"))
    at = F.concat_ws("/", F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), "name")
    found = wanted.withColumn("target", at).join(css.select(F.col("path").alias("target"), F.col("content").alias("inner")), "target")
    front = found.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "inner"))), lambda x: x["inner"]), "\n").alias("front"))
    return css.join(front, "path", "left").select("path", F.concat_ws("\n", "front", F.regexp_replace("content", r"@import[^;]*;\s*", "")).alias("content"))


def html_pages(files: DataFrame) -> DataFrame:
    """(id, title, regions, components, source_path, warnings) of HTML pages."""
    html = files.where(F.col("path").rlike(r"\.html?$"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html?$", "")
    tags = ("header", "nav", "main", "aside", "footer")
    part = lambda tag: F.regexp_extract("content", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    regions = F.filter(F.array(*(F.struct(F.lit(t).alias("region"), T.data_components(part(t)).alias("components")) for t in tags)), lambda r: F.size(r["components"]) > 0)
    components = T.data_components(F.col("content"))
    return html.select(T.slug(name).alias("id"), T.html_title(F.col("content"), name).alias("title"), regions.alias("regions"), components.alias("components"), F.col("path").alias("source_path"), F.when(F.size(components) == 0, F.array(F.lit("no components"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


FIGMA = "variables array<struct<name:string,value:string,resolvedType:string>>, components array<struct<name:string,key:string,description:string>>"


def camel(name: Column) -> Column:
    """color/primary-dark -> colorPrimaryDark."""
    joined = F.array_join(F.transform(F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substr(joined, F.lit(2)))


def figma(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, components) of exports of variables and components (S26, F18): numbers are px, components drafts."""
    docs = files.where(F.endswith("path", F.lit(".json")) & F.contains("content", F.lit('"variables"'))).select("path", F.from_json("content", FIGMA).alias("d"))
    v = docs.select(F.explode("d.variables").alias("v")).select("v.*")
    name = camel(F.col("name"))
    value = F.when((F.col("resolvedType") == "FLOAT"), F.concat(F.regexp_replace("value", r"\.0$", ""), F.lit("px"))).otherwise(F.col("value"))
    tokens = v.select(name.alias("name"), value.alias("value"), T.ordered_bucket(name, T.TOKEN_BUCKETS).alias("bucket"))
    c = docs.select(F.explode("d.components").alias("c")).select("c.*")
    last = F.element_at(F.split("name", "/"), -1)
    pascal = F.concat(F.upper(F.substring(camel(last), 1, 1)), F.substr(camel(last), F.lit(2)))
    return tokens, c.select(pascal.alias("id"), "description", F.lit("draft-from-figma").alias("status"))


def manifest(files: DataFrame, types: tuple[str, ...] = ("auth", "list", "form", "detail", "dashboard", "settings")) -> DataFrame:
    """(path, id, page_type, errors) of page manifests (F32, P10): every broken rule is an error, accepted ones have none."""
    m = files.where(F.endswith("path", F.lit("manifest.json"))).select("path", F.from_json("content", "id string, pageType string, title string").alias("m"))
    bad = lambda test, what: F.when(test, F.lit(what))
    known = F.coalesce(F.col("m.pageType").isin(*types), F.lit(False))
    return m.select(
        "path", F.col("m.id").alias("id"), F.col("m.pageType").alias("page_type"),
        F.array_compact(F.array(bad(F.col("m").isNull() | F.col("m.id").isNull(), "id is missing"), bad(F.col("m.id").isNotNull() & ~F.col("m.id").rlike("^[a-z][a-z0-9-]*$"), "id is no slug"), bad(~known, "unknown page type"), bad(F.col("m.title").isNull(), "title is missing"))).alias("errors"),
    )


PAGE = "id string, title string, components array<string>, source_path string, warnings array<string>"
PROFILE = "tool string, source_path string, role string, synced_at timestamp"
BINDING = "semantic_id string, library string, framework string, module string, component string, props string"


def design_systems(files: DataFrame) -> dict[str, DataFrame]:
    """tokens, components and pages of design projects with several systems.

    A project's _d_meta.json names its systems (slug, dsFolder) and pages (assets with versions); a system's folder has
    _ds_manifest.json with its components, a prompt for each, and tokens.css or styles.css. Without a project file each
    folder with a manifest is a system. The last system wins a token or component that several have; components
    without a prompt get a warning instead of a description.
    """
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    meta = files.where(base(F.col("path")) == "_d_meta.json").select(folder(F.col("path")).alias("_root"), F.from_json(F.regexp_replace("content", "^\ufeff", ""), "primaryDesignSystem string, designSystems array<struct<slug:string,dsFolder:string>>, assets map<string,struct<versions:array<struct<path:string>>>>").alias("m"))
    system = meta.select("_root", F.posexplode("m.designSystems").alias("rank", "s")).select(F.concat_ws("/", F.nullif("_root", F.lit("")), F.coalesce("s.dsFolder", F.concat(F.lit("_ds/"), "s.slug"))).alias("at"), "rank")
    manifests = files.where(base(F.col("path")) == "_ds_manifest.json").select(folder(F.col("path")).alias("at"), F.from_json(F.regexp_replace("content", "^\ufeff", ""), "components array<string>").alias("m"))
    ranked = manifests.join(system, "at", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    listed = ranked.select("at", "rank", F.explode("m.components").alias("c"))
    own = F.coalesce(F.get_json_object("c", "$.id"), F.get_json_object("c", "$.name"))
    wanted = listed.select("at", "rank", F.when(F.startswith("c", F.lit("{")), own).otherwise(F.col("c")).alias("id")).where("id IS NOT NULL")
    prompts = files.where(F.endswith("path", F.lit(".prompt.md"))).select(F.regexp_extract("path", r"^(.*?)/?components/", 1).alias("at"), F.regexp_replace(base(F.col("path")), r"\.prompt\.md$", "").alias("id"), "content", "path")
    said = R.first_wins(prompts, ["at", "id"], [F.desc(F.length("path")), "path"])
    role = F.nullif(F.trim(F.regexp_extract("content", r"^#[^\n]*\n+([^\n#]+)", 1)), F.lit(""))
    parts = wanted.join(said, ["at", "id"], "left").select("id", F.coalesce(role, F.lit("")).alias("description"), F.when(F.col("content").isNull(), "no-prompt").otherwise("described").alias("status"), "rank", "at")
    sheets = files.where(base(F.col("path")).isin("tokens.css", "styles.css")).select("path", F.regexp_replace(folder(F.col("path")), "/?(tokens|styles|css)$", "").alias("at")).join(ranked.select("at", "rank"), "at")
    inlined = inline_imports(files).join(sheets, "path")
    tokens = inlined.select("at", "rank", "path", F.explode(T.css_properties(F.col("content"))).alias("name", "value"))
    last = R.last_wins(tokens, ["name"], ["rank", "path"])
    asset = meta.select("_root", F.explode("m.assets").alias("title", "a")).select("_root", "title", F.try_element_at("a.versions", F.lit(-1))["path"].alias("file")).where("file IS NOT NULL")
    slug = F.coalesce(F.nullif(T.slug(F.col("title")), F.lit("")), T.slug(F.regexp_replace(base(F.col("file")), r"\.\w+$", "")))
    none = F.array().cast("array<string>")
    return {
        "tokens": last.select("name", "value", T.ordered_bucket(F.regexp_replace("name", "^--", ""), T.TOKEN_BUCKETS).alias("bucket")),
        "components": R.last_wins(parts, ["id"], ["rank", "at"]).select("id", "description", "status"),
        "pages": asset.select(slug.alias("id"), "title", none.alias("components"), F.concat_ws("/", F.nullif("_root", F.lit("")), "file").alias("source_path"), none.alias("warnings")),
    }


def v0_pages(files: DataFrame) -> DataFrame:
    """Pages of folders with a page.manifest.json, and the page.tsx and page.logic.md beside it.

    Warnings say when the manifest is not approved, when there is no page.tsx, and when page.tsx looks like another page type.
    """
    at = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.element_at(F.split("path", "/"), -1)
    m = files.where(name == "page.manifest.json").select(at.alias("at"), "path", F.from_json("content", "id string, title string, pageType string, status string").alias("m")).where("m.id IS NOT NULL")
    tsx = files.where(name == "page.tsx").select(at.alias("at"), F.col("content").alias("_tsx"))
    both = m.join(tsx, "at", "left").withColumn("_kind", page_type(F.col("_tsx")))
    warn = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("m.status"), F.lit("approved")) != "approved", F.concat(F.lit("status is "), "m.status")),
            F.when(F.col("_tsx").isNull(), F.lit("no page.tsx")),
            F.when(F.col("_tsx").isNotNull() & (F.col("_kind") != F.col("m.pageType")) & (F.col("_kind") != "detail"), F.concat(F.lit("page.tsx looks like "), "_kind")),
        )
    )
    return both.select("m.id", F.coalesce("m.title", "m.id").alias("title"), F.coalesce(T.data_components(F.col("_tsx")), F.array().cast("array<string>")).alias("components"), F.col("path").alias("source_path"), warn.alias("warnings"))


def profile(files: DataFrame) -> DataFrame:
    """(tool, source_path, role, synced_at): the design sources that files have, one row each."""
    name = F.element_at(F.split("path", "/"), -1)
    tool = (
        F.when(name == "_d_meta.json", "design-project").when(name == "_ds_manifest.json", "design-system").when(name == "page.manifest.json", "page")
        .when(F.endswith("path", F.lit(".json")) & F.contains("content", F.lit('"variables"')), "variables").when(F.endswith("path", F.lit(".css")), "style-sheet").when(F.col("path").rlike(r"\.html?$"), "html")
    )
    role = F.when(tool.isin("design-project", "design-system", "variables"), "primary").otherwise("secondary")
    return files.select(tool.alias("tool"), F.col("path").alias("source_path"), role.alias("role"), F.current_timestamp().alias("synced_at")).where("tool IS NOT NULL")


def affected(changed: DataFrame) -> DataFrame:
    """One row of flags tokens, style, components, pages: what a set of changed paths bears on."""
    name = F.element_at(F.split("path", "/"), -1)
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return changed.agg(
        hit(F.endswith(name, F.lit(".css")) | (F.endswith(name, F.lit(".json")) & ~name.isin("_d_meta.json", "page.manifest.json", "manifest.json"))).alias("tokens"),
        hit(name.isin("_ds_prompt.md", "README.md")).alias("style"),
        hit((name == "_ds_manifest.json") | F.endswith(name, F.lit(".prompt.md")) | (F.endswith(name, F.lit(".json")) & ~name.isin("_d_meta.json", "page.manifest.json", "manifest.json"))).alias("components"),
        hit(name.isin("_d_meta.json", "page.manifest.json", "page.logic.md", "page.tsx") | name.rlike(r"(?i)\.html?$")).alias("pages"),
    )


SEMANTIC = "PrimaryButton SecondaryButton Card PageHeader Input Select Checkbox Radio Switch Form Table Modal Alert EmptyState SkeletonList Tabs Breadcrumb Pagination Tag Tooltip Dropdown Toast".split()
_USUAL = {"PrimaryButton": "Button", "SecondaryButton": "Button", "EmptyState": "Empty", "SkeletonList": "Skeleton"}
_SHADCN, _MUI = "@/components/ui/{lower}", "@mui/material"
#: Libraries: framework, aliases, module, prefix of names, names that are not the usual ones, properties.
LIBRARIES: dict[str, tuple[str, tuple[str, ...], str, str, dict[str, str], dict[str, str]]] = {
    "element-plus": ("vue", ("elementplus", "el-plus"), "element-plus", "El", {"Modal": "Dialog", "Toast": "Message"}, {"PrimaryButton": '{"type":"primary"}', "SkeletonList": '{"rows":4,"animated":true}'}),
    "ant-design-vue": ("vue", ("antd-vue", "antdv"), "ant-design-vue", "A", {"Toast": "=message"}, {"PrimaryButton": '{"type":"primary"}', "SkeletonList": '{"active":true}'}),
    "antd": ("react", ("ant-design", "antd-react"), "antd", "", {"Toast": "=message"}, {"PrimaryButton": '{"type":"primary"}', "SkeletonList": '{"active":true}'}),
    "shadcn/ui": ("react", ("shadcn", "shadcn-ui"), _SHADCN, "", {"Radio": "RadioGroup", "Modal": "Dialog", "Tag": "Badge", "Dropdown": "DropdownMenu", "Toast": "=toast"}, {"PrimaryButton": '{"variant":"default"}', "SecondaryButton": '{"variant":"secondary"}'}),
    "mui": ("react", ("material-ui", "@mui/material"), _MUI, "", {"PageHeader": "Typography", "Input": "TextField", "Form": "Box", "Modal": "Dialog", "EmptyState": "Typography", "Breadcrumb": "Breadcrumbs", "Tag": "Chip", "Dropdown": "Menu", "Toast": "Snackbar"}, {"PrimaryButton": '{"variant":"contained","color":"primary"}', "SecondaryButton": '{"variant":"outlined"}', "SkeletonList": '{"variant":"rectangular","height":48}'}),
}


def library_of(name: str) -> str:
    """The library that a name or alias means, whatever its case (F30); an unknown one raises with the known names."""
    low = name.strip().lower()
    for key, (_, aliases, *_) in LIBRARIES.items():
        if low in (key, *aliases):
            return key
    raise ValueError(f"unknown library {name}; known: {', '.join(LIBRARIES)}")


def bindings(spark: SparkSession, library: str, framework: str) -> DataFrame:
    """(semantic_id, library, framework, module, component, props): a library's binding of every semantic component."""
    key = library_of(library)
    wants, _, module, prefix, other, props = LIBRARIES[key]
    if wants != framework:
        raise ValueError(f"{key} is for {wants}, not {framework}")
    rows = []
    for sid in SEMANTIC:
        name = other.get(sid, _USUAL.get(sid, sid))
        name = name[1:] if name.startswith("=") else prefix + name
        rows.append((sid, key, wants, module.format(lower=name.lower()), name, props.get(sid)))
    return spark.createDataFrame(rows, BINDING)


def merge_profiles(pages: DataFrame, adapter_rank: str = "rank") -> DataFrame:
    """Pages of all adapters, the best-ranked by id, with the warnings of all."""
    w = Window.partitionBy("id")
    united = pages.withColumn("warnings", F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings").over(w)))))
    return R.first_wins(united, ["id"], [adapter_rank, "source_path"])


def violations(files: DataFrame, allowed_px: tuple[str, ...] = ("0px", "1px")) -> DataFrame:
    """(path, line, kind, match): colours and sizes written out instead of tokens."""
    lines = files.where(F.col("path").rlike(r"\.(css|scss|vue|tsx|jsx)$")).select("path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "text"))
    lines = lines.withColumn("text", F.regexp_replace("text", r"--[\w-]+\s*:[^;}]*", ""))  # where tokens are defined
    hits = lambda kind, p: F.transform(F.regexp_extract_all("text", F.lit(p), 0), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("match")))
    both = F.explode(F.concat(hits("hex", r"#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3})(?![0-9a-zA-Z])"), hits("px", r"(?<![\w.#-])\d+(?:\.\d+)?px"))).alias("v")
    return lines.select("path", (F.col("n") + 1).alias("line"), both).select("path", "line", "v.kind", "v.match").where(~F.col("match").isin(*allowed_px))


def gaps(pages: DataFrame, components: DataFrame, bindings: DataFrame) -> DataFrame:
    """(kind, id): components that pages use and nobody defines, bindings of nothing, components without a binding."""
    used = pages.select(F.explode("components").alias("id")).distinct()
    return R.union_all(
        [
            used.join(components, "id", "left_anti").select(F.lit("undefined_component").alias("kind"), "id"),
            bindings.join(components, "id", "left_anti").select(F.lit("orphan_binding").alias("kind"), "id"),
            components.join(bindings, "id", "left_anti").select(F.lit("missing_binding").alias("kind"), "id"),
        ]
    ).distinct()


def stale(docs: DataFrame, epsilon_ms: float = 0.5) -> DataFrame:
    """docs(id, updated_at, source_mtime_ms) whose source is younger than they are."""
    return docs.where(F.col("source_mtime_ms") - F.unix_millis("updated_at") > epsilon_ms)


def align(components: DataFrame, bindings: DataFrame) -> DataFrame:
    """(package, name, semantic_id, confidence, ties): the binding that fits each component best.

    100 for equal names, 80 for equal names without prefixes and signs, 40 for one inside the other's end, 30 for
    one inside the other; high from 80, low below, "none" without a fit. Exact tiers are equi-joins; only what they
    leave goes through the comparison of all pairs, whose binding side is a library's component list.
    """
    a = components.select("package", "name", T.plain_name(T.strip_prefix(F.col("name"))).alias("plain"))
    b = bindings.select("semantic_id", F.col("component").alias("bound"), T.plain_name(T.strip_prefix(F.col("component"))).alias("bound_plain"))
    exact = a.join(b, a["plain"] == b["bound_plain"]).select("package", "name", "semantic_id", F.when(F.col("name") == F.col("bound"), 100).otherwise(80).alias("score"))
    rest = a.join(exact.select("package", "name").distinct(), ["package", "name"], "left_anti")
    close = rest.join(b, (F.length("plain") > 0) & (F.length("bound_plain") > 0) & (F.contains("plain", F.col("bound_plain")) | F.contains("bound_plain", F.col("plain"))))
    at_end = F.endswith("plain", F.col("bound_plain")) | F.endswith("bound_plain", F.col("plain"))
    scored = exact.unionByName(close.select("package", "name", "semantic_id", F.when(at_end, 40).otherwise(30).alias("score")))
    best = R.best_matches(scored, ["package", "name"], "score", "semantic_id")
    out = components.select("package", "name").join(best, ["package", "name"], "left")
    return out.select("package", "name", "semantic_id", F.when(F.col("score") >= 80, "high").when(F.col("score").isNotNull(), "low").otherwise("none").alias("confidence"), F.coalesce("ties", F.lit(0)).alias("ties"))
