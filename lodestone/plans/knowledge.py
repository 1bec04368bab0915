"""From files to knowledge: endpoints, entities, the flow and call graphs, cards, chunks and the index."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as T
from lodestone.operators import relational as R
from lodestone.operators import rules as rules_
from lodestone.operators import search as S
from lodestone.operators.audit import affected_units, classify
from lodestone.operators.graph import endpoints
from lodestone.operators.tree import flatten
from lodestone.shared import together
from lodestone.sources import code, files as files_, native
from lodestone.sources.files import extract
from lodestone.sources.store import Store, markdown_sections, markdown_table

Rules = Sequence[tuple[str, str]]


@dataclass
class Plugin:
    """An extractor that users add (S-plugins): its phase names the table whose rows it gives."""

    name: str
    phase: str
    scan: Callable[[DataFrame], DataFrame]


def owned(df: DataFrame, modules: DataFrame) -> DataFrame:
    """df(file, ...) with module_slug, the nearest module's that holds the file; "" if none does."""
    rooted = modules.select(F.col("slug").alias("module_slug"), F.concat(F.lit("/"), "path").alias("_unit"))
    at = df.select("file").distinct().withColumn("_at", F.concat(F.lit("/"), "file"))
    best = R.owner(at, "_at", rooted, "_unit", ["file"]).select("file", "module_slug")
    base = rooted.where("_unit = '/'").agg(F.max("module_slug").alias("_root"))
    return df.join(best, "file", "left").crossJoin(base).withColumn("module_slug", F.coalesce("module_slug", "_root", F.lit(""))).drop("_root")


def java_endpoints(files: DataFrame, modules: DataFrame, rules: Rules = ()) -> DataFrame:
    """Endpoints of Java controllers (S4), with the prefix of the first rule that fits their package."""
    raw = extract(files, code.java_apis, "file string, package string, class string, method string, path string, summary string, pos int", ["Mapping"], [".java"])
    ruled = R.ant_rules(raw, "package", rules).withColumn("path", T.join_path(F.col("prefix"), F.col("path")))
    inside = F.when(F.contains("path", F.lit("/internal")), "internal").otherwise("public")
    return owned(ruled, modules).select(F.concat("method", F.lit("-"), "path").alias("id"), "method", "path", "summary", F.array("class").alias("tags"), inside.alias("audience"), F.lit("java").alias("source"), "module_slug", "file", "pos")


def apis(files: DataFrame, modules: DataFrame, rules: Rules = ()) -> DataFrame:
    """All endpoints in one shape; those of OpenAPI documents win over those read from code."""
    found = R.union_all([java_endpoints(files, modules, rules), _unified(go_endpoints(files), modules, "go", "id"), _unified(python_endpoints(files), modules, "python")])
    return R.prefer(native.openapi(files), found, ["method", "path"])


def _unified(routes: DataFrame, modules: DataFrame, source: str, key: str | None = None) -> DataFrame:
    """Endpoints of other languages in the shape of Java's."""
    inside = F.when(F.contains("path", F.lit("/internal")), "internal").otherwise("public")
    name = F.col(key) if key else F.concat("method", F.lit("-"), "path")
    summary = F.col("handler") if "handler" in routes.columns else F.concat_ws(" ", "method", "path")
    return owned(routes, modules).select(name.alias("id"), "method", "path", summary.alias("summary"), F.array().cast("array<string>").alias("tags"), inside.alias("audience"), F.lit(source).alias("source"), "module_slug", "file", "pos")


def go_endpoints(files: DataFrame) -> DataFrame:
    """Go routes with the prefix of the latest group at or before them in their file (S11, W3) and running ids."""
    raw = extract(files, code.go_routes, "file string, kind string, receiver string, method string, path string, pos int", ["GET", "POST", "Handle", "Get(", "Post(", "PUT", "DELETE"], [".go"])
    w = Window.partitionBy("file").orderBy("pos", F.when(F.col("kind") == "group", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    with_prefix = raw.withColumn("_prefix", F.last(F.when(F.col("kind") == "group", F.col("path")), ignorenulls=True).over(w)).where("kind = 'route'")
    path = T.join_path(F.coalesce("_prefix", F.lit("")), F.col("path"))
    n = F.row_number().over(Window.partitionBy(F.substring_index("file", "/", 1)).orderBy("file", "pos")) - 1
    return with_prefix.select(F.concat(F.lit("go-api-"), F.substring_index("file", "/", 1), F.lit("-"), n).alias("id"), "method", path.alias("path"), "file", "pos")


def python_endpoints(files: DataFrame) -> DataFrame:
    """Routes of FastAPI, Flask, Django and Tornado."""
    return extract(files, code.python_routes, "file string, method string, path string, handler string, pos int", suffixes=[".py"])


def other_entities(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Fields of Go structs and of Python's pydantic, Django and SQLAlchemy classes in the shape of JPA's."""
    go = extract(files, code.go_structs, "file string, entity string, name string, type string, tag string, pos int", ["struct"], [".go"]).withColumn("source", F.lit("go"))
    py = extract(files, code.python_classes, "file string, entity string, bases string, name string, type string, pos int", ["class "], [".py"])
    py = py.where(F.col("bases").rlike(r"\b(BaseModel|Model|Base|DeclarativeBase|SQLModel|Document)\b")).withColumn("source", F.lit("python"))
    both = go.select("file", "entity", "name", "type", "source", "pos").unionByName(py.select("file", "entity", "name", "type", "source", "pos"))
    table = F.lower(F.regexp_replace("entity", "(?<=[a-z0-9])(?=[A-Z])", "_"))
    return owned(both, modules).select("module_slug", "entity", table.alias("table"), "name", "type", F.lit(None).cast("string").alias("column"), F.lit(None).cast("boolean").alias("nullable"), "source", F.lit(4).alias("rank"), "file", "pos")


ENTITY_FIELDS = "file string, entity string, table string, name string, type string, column string, nullable boolean, pos int"


def entities(files: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, relations): JPA before MyBatis before SQL before Go and Python, fields united by lower-case name (U5, A10); tables of SQL have no module."""
    jpa = owned(extract(files, code.jpa_fields, ENTITY_FIELDS, ["@Entity"], [".java"]), modules).select("module_slug", "entity", "table", "name", "type", "column", "nullable", F.lit("jpa").alias("source"), F.lit(1).alias("rank"), "file", "pos")
    fields, mybatis_rel = native.mybatis(files)
    mybatis = owned(fields, modules).select("module_slug", "entity", F.lower(F.regexp_replace("entity", "(?<=[a-z0-9])(?=[A-Z])", "_")).alias("table"), "name", F.lit("unknown").alias("type"), "column", F.lit(None).cast("boolean").alias("nullable"), F.lit("mybatis").alias("source"), F.lit(2).alias("rank"), "file", "pos")
    cols, sql_rel = native.sql_tables(files)
    sql = cols.select(F.lit("").alias("module_slug"), F.col("table").alias("entity"), "table", "name", "type", F.col("name").alias("column"), "nullable", F.lit("sql").alias("source"), F.lit(3).alias("rank"), "file", "pos")
    merged = R.merge_ranked(R.union_all([jpa, mybatis, sql, other_entities(files, modules)]), ["module_slug", "table"], "name", "rank", ["file", "pos"])
    jpa_rel = extract(files, code.jpa_relations, "src string, dst string, kind string, field string, source string, file string, pos int", ["@Entity"], [".java"])
    ranked = R.union_all([jpa_rel.withColumn("rank", F.lit(1)), mybatis_rel.withColumn("rank", F.lit(2)), sql_rel.withColumn("rank", F.lit(3))])
    return merged, R.first_wins(ranked, ["src", "dst", "kind"], ["rank", "file", "pos"])


METHODS = "file string, class string, name string, signature string, annotations array<string>, pos int"
CALLS = "file string, class string, method string, receiver string, called string, pos int"
FIELDS = "file string, class string, class_kind string, name string, type string, pos int"


def call_graph_java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of methods, DTOs and the calls and uses between them."""
    methods = extract(files, code.java_methods, METHODS, suffixes=[".java"])
    calls = extract(files, code.java_calls, CALLS, suffixes=[".java"])
    fields = R.first_wins(extract(files, code.java_fields, FIELDS, suffixes=[".java"]), ["class", "name"], ["file", "pos"])
    is_dto = F.col("class").rlike("(DTO|VO|BO|DO|Req|Resp|Request|Response)$")
    mid = lambda c, m: F.concat(F.lit("method:"), c, F.lit("#"), m)
    m_nodes = methods.where(~is_dto).select(mid(F.col("class"), F.col("name")).alias("id"), F.lit("method").alias("kind"), F.concat("class", F.lit("."), "name").alias("name"), "file", T.backend_layer(F.col("file")).alias("layer"), "annotations", "signature", "pos")
    d_nodes = fields.where(is_dto).groupBy(F.concat(F.lit("dto:"), "class").alias("id")).agg(F.lit("dto").alias("kind"), F.min("class").alias("name"), F.min("file").alias("file"), F.sort_array(F.collect_list(F.struct("pos", "name", "type"))).alias("_f"))
    d_nodes = d_nodes.select("id", "kind", "name", "file", F.transform("_f", lambda x: F.concat(x["name"], F.lit(": "), x["type"])).alias("fields"))
    nodes = R.first_wins(m_nodes, ["id"], ["file", "pos"]).drop("pos").unionByName(d_nodes, allowMissingColumns=True)
    typed = fields.select("class", F.col("name").alias("receiver"), F.col("type").alias("target"))
    resolved = calls.join(typed, ["class", "receiver"], "left").withColumn("target", F.when(F.col("receiver") == "this", F.col("class")).otherwise(F.col("target"))).where("target IS NOT NULL")
    own = F.col("target") == F.col("class")
    exists = methods.select(F.col("class").alias("target"), F.col("name").alias("called")).distinct().withColumn("_there", F.lit(True))
    known = resolved.join(exists, ["target", "called"], "left").where((F.col("receiver") != "this") | F.col("_there"))
    call_edges = known.select(mid(F.col("class"), F.col("method")).alias("src"), mid(F.col("target"), F.col("called")).alias("dst"), F.lit("calls").alias("kind"), F.when(own, "low").otherwise("high").alias("confidence"), "file", "pos")
    dto_names = d_nodes.select(F.col("name").alias("dto"))
    uses = R.term_join(methods.where(~is_dto), "signature", dto_names, "dto").select(mid(F.col("class"), F.col("name")).alias("src"), F.concat(F.lit("dto:"), "dto").alias("dst"), F.lit("uses").alias("kind"), F.lit("high").alias("confidence"), "file", "pos")
    return nodes, R.first_wins(call_edges.unionByName(uses), ["src", "dst", "kind"], ["file", "pos"])


def call_graph_others(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Go and Python methods and the calls between those that the tree defines.

    A call leads to the methods of its name in its own language: on self or the receiver's class to its own class's, else to
    those of the class or package that it names, else, if a single class has a method of that name, to that one.
    """
    go = extract(files, code.go_calls, "file string, function string, receiver string, called string, pos int", ["func "], [".go"])
    go = go.select("file", F.when(F.contains("function", F.lit(".")), F.substring_index("function", ".", 1)).alias("class"), F.substring_index("function", ".", -1).alias("name"), "receiver", "called", "pos", F.lit("go").alias("lang"))
    py = extract(files, code.python_methods, "file string, class string, name string, receiver string, called string, pos int", ["def "], [".py"]).withColumn("lang", F.lit("python"))
    rows = go.unionByName(py)
    owner = F.coalesce("class", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.\w+$", ""))
    rows = rows.withColumn("owner", owner)
    mid = lambda o, n: F.concat(F.lit("method:"), o, F.lit("#"), n)
    methods = R.first_wins(rows.select(mid(F.col("owner"), F.col("name")).alias("id"), "owner", "name", "class", "file", "lang", "pos"), ["id"], ["file", "pos"])
    nodes = methods.select("id", F.lit("method").alias("kind"), F.concat_ws(".", "class", "name").alias("name"), "file", F.lit("service").alias("layer"))
    targets = methods.select("lang", F.col("name").alias("called"), F.col("owner").alias("target"), F.col("id").alias("dst"))
    only = Window.partitionBy("lang", "called")
    targets = targets.withColumn("_n", F.count("*").over(only))
    # each way to a method is a key of the join, so a name that many classes have doesn't meet all of them
    outside = ~F.col("receiver").isin("self", "cls")
    keys = lambda own, name, only: F.explode(F.array_compact(F.array(own, F.concat(F.lit("named:"), F.lower(name)), F.when(only, "only")))).alias("_key")
    owned_by = lambda c: F.concat(F.lit("own:"), c)
    calls = rows.where("called IS NOT NULL").select("lang", "called", "owner", "name", "file", "pos", keys(F.when(~outside, owned_by("owner")), "receiver", outside))
    kept = calls.join(targets.select("lang", "called", "dst", keys(owned_by("target"), "target", F.col("_n") == 1)), ["lang", "called", "_key"])
    edges = kept.select(mid(F.col("owner"), F.col("name")).alias("src"), "dst", F.lit("calls").alias("kind"), F.when(F.col("_key") == "only", "low").otherwise("high").alias("confidence"), "file", "pos")
    return nodes, R.first_wins(edges, ["src", "dst", "kind"], ["confidence", "file", "pos"])


def call_graph_frontend(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of components: imports that lead to a file, and tags that a template uses."""
    some = files.where(F.col("path").rlike(r"\.(vue|tsx?|jsx?)$"))
    raw = extract(some, _import_options, "file string, name string, pos int, options array<string>")
    found = R.candidates(raw, F.col("options"), some.select(F.col("path").alias("target")), "target", ["file", "name", "pos"])
    cid = lambda c: F.concat(F.lit("component:"), c)
    imports = found.select(cid(F.col("file")).alias("src"), cid(F.col("target")).alias("dst"), F.lit("imports").alias("kind"), F.lit("high").alias("confidence"), "file", "pos")
    tags = native.vue_tags(files).select("file", F.explode("tags").alias("name"))
    template = found.join(tags, ["file", "name"]).select(cid(F.col("file")).alias("src"), cid(F.col("target")).alias("dst"), F.lit("template").alias("kind"), F.lit("high").alias("confidence"), "file", "pos")
    edges = R.first_wins(imports.unionByName(template), ["src", "dst", "kind"], ["file", "pos"])
    path = F.regexp_replace("id", "^component:", "")
    nodes = endpoints(edges).select("id", F.lit("component").alias("kind"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.\w+$", "").alias("name"), path.alias("file"))
    return nodes, edges


def _import_options(path: str, source: str) -> list[tuple]:
    return [(p, n, pos, code.resolve(p, target)) for p, n, target, pos in code.imports(path, source)]


def flow_graph(files: DataFrame, fields: DataFrame, rpcs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from entities to the backend and frontend files that name them, and from callers to RPCs."""
    names = fields.select("entity").distinct()
    entity_nodes = names.select(F.concat(F.lit("entity:"), "entity").alias("id"), F.lit("entity").alias("layer"), F.col("entity").alias("name"), F.lit(None).cast("string").alias("file"))
    layer = F.coalesce(F.when(F.endswith("path", F.lit(".java")), T.backend_layer(F.col("path"))), F.when(F.col("path").rlike(r"\.(vue|tsx?|jsx?)$"), native.frontend_kind(F.col("path"), F.col("content"))))
    layered = files.withColumn("layer", layer).where("layer IS NOT NULL AND layer <> 'util'")
    back = F.endswith("path", F.lit(".java"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", "")
    node_id = F.concat("layer", F.lit(":"), F.when(back, stem).otherwise(F.col("path")))
    hits = R.term_join(layered.where(back), "content", names, "entity")
    # a line that declares, maps or injects the entity is strong evidence, a mere mention weak
    strong = F.exists(F.split("content", r"\r?\n"), lambda x: F.contains(x, F.col("entity")) & x.rlike(r"<[^>]*>|\bextends\b|\bimplements\b|@Select|@Insert|@Update|@Query"))
    edges = hits.select(F.concat(F.lit("entity:"), "entity").alias("src"), node_id.alias("dst"), F.when(strong, "high").otherwise("low").alias("confidence"), F.lit("uses").alias("label"), F.col("path").alias("file"), F.lit(0).alias("pos"))
    lower = names.select("entity", F.lower("entity").alias("_low"))
    front_tokens = layered.where(~back).withColumn("_t", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), 0))))
    front = front_tokens.join(lower, front_tokens["_t"] == lower["_low"])
    edges = edges.unionByName(front.select(node_id.alias("src"), F.concat(F.lit("entity:"), "entity").alias("dst"), F.lit("low").alias("confidence"), F.lit("mentions").alias("label"), F.col("path").alias("file"), F.lit(0).alias("pos")))
    nodes = entity_nodes.unionByName(layered.select(node_id.alias("id"), "layer", stem.alias("name"), F.col("path").alias("file")))
    if rpcs is not None:
        clients = rpcs.select(F.col("interface").alias("type")).distinct()
        wired = extract(files, code.java_fields, FIELDS, suffixes=[".java"]).join(clients, "type", "left_semi")
        rid = F.concat(F.lit("rpc:"), "type")
        caller = F.concat(F.coalesce(T.backend_layer(F.col("file")), F.lit("service")), F.lit(":"), "class")
        nodes = nodes.unionByName(clients.select(rid.alias("id"), F.lit("rpc").alias("layer"), F.col("type").alias("name"), F.lit(None).cast("string").alias("file")))
        base = F.regexp_replace(F.regexp_replace("type", "Client$", ""), "Feign$", "")
        options = F.transform(F.array(F.concat(base, F.lit("Service")), F.concat(base, F.lit("ServiceImpl")), base), lambda x: F.concat(F.lit("service:"), x))
        target = R.candidates(clients.withColumn("base", base), options, nodes.where("layer = 'service'").select(F.col("id").alias("target")).distinct(), "target", ["type"])
        edges = R.union_all(
            [
                edges,
                wired.select(caller.alias("src"), rid.alias("dst"), F.lit("high").alias("confidence"), F.lit("calls").alias("label"), "file", "pos"),
                target.select(rid.alias("src"), F.col("target").alias("dst"), F.lit("high").alias("confidence"), F.lit("serves").alias("label"), F.lit("").alias("file"), F.lit(0).alias("pos")),
            ]
        )
    return R.first_wins(nodes, ["id"], [F.asc_nulls_last("file"), "name"]), R.first_wins(edges, ["src", "dst"], ["confidence", "file", "pos"])


def cards(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Cards of reusable code with stable ids (S21, S23, S24, P11, B2): all kinds that the classifiers know."""
    java = owned(native.java_kinds(files), modules).select("kind", "name", "module_slug", F.lit("").alias("description"), F.array("name").alias("exports"), F.col("file").alias("source_path"), F.lit("backend").alias("scope"))
    docs = native.ts_docs(files)
    exports = native.ts_exports(files).groupBy("file").agg(F.sort_array(F.collect_set("name")).alias("exports"))
    front = files.where(F.col("path").rlike(r"\.(vue|tsx?|jsx?)$")).select(F.col("path").alias("file"), native.frontend_kind(F.col("path"), F.col("content")).alias("kind")).where("kind IS NOT NULL")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.\w+$", "")
    none = F.array().cast("array<string>")
    web = front.join(docs, "file", "left").join(exports, "file", "left").select("kind", stem.alias("name"), F.substring_index("file", "/", 1).alias("module_slug"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("exports", none).alias("exports"), F.col("file").alias("source_path"), F.lit("frontend").alias("scope"))
    both = java.unionByName(web)
    return R.first_wins(both.withColumn("id", T.asset_id(F.col("scope"), F.col("module_slug"), F.col("kind"), F.col("name"))), ["id"], ["source_path"])


def chunks(card: DataFrame, api: DataFrame) -> DataFrame:
    """One chunk per card and endpoint, with ids that stay the same from scan to scan."""
    of_card = card.select(S.chunk_id(F.col("id"), F.col("kind")).alias("id"), F.concat_ws("/", "scope", "module_slug", "kind").alias("path"), F.col("name").alias("anchor"), "kind", F.col("name").alias("title"), T.asset_text(F.col("kind"), F.col("name"), F.col("description"), F.col("exports")).alias("text"), "source_path")
    of_api = api.select(S.chunk_id(F.lit("api"), F.col("id"), F.col("module_slug")).alias("id"), F.concat_ws("/", F.lit("backend"), "module_slug", F.lit("api")).alias("path"), F.col("id").alias("anchor"), F.lit("api").alias("kind"), F.concat_ws(" ", "method", "path").alias("title"), F.concat_ws("\n", F.concat_ws(" ", "method", "path"), "summary", F.array_join("tags", ", ")).alias("text"), F.col("file").alias("source_path"))
    return R.first_wins(of_card.unionByName(of_api), ["id"], ["source_path", "text"])


def index(chunk: DataFrame) -> DataFrame:
    """(path, kind, title, parent, children, chunks): the tree of scopes, modules and kinds, made from the chunks."""
    leaf = chunk.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("chunks"))
    wide = leaf.select(F.explode(R.ancestors(F.concat(F.lit("/"), "path"))).alias("at")).distinct()
    parent = F.nullif(F.regexp_replace("at", "/[^/]*$", ""), F.lit(""))
    nodes = wide.select(F.substr("at", F.lit(2)).alias("path"), F.element_at(F.split("at", "/"), -1).alias("title"), F.substr(parent, F.lit(2)).alias("parent"))
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(F.col("path"))).alias("children"))
    depth = F.size(F.split("path", "/"))
    kind = F.when(depth == 1, "scope").when(depth == 2, "module").otherwise("kind")
    none = F.array().cast("array<string>")
    return nodes.join(below, "path", "left").join(leaf, "path", "left").select("path", kind.alias("kind"), "title", "parent", F.coalesce("children", none).alias("children"), F.coalesce("chunks", none).alias("chunks"))


RPCS = "file string, client string, interface string, method string, http string, path string, pos int"


def rpcs(files: DataFrame) -> DataFrame:
    """Methods of Feign clients and of proto services, which have no HTTP method and the path /service/method."""
    feign = extract(files, code.java_rpcs, RPCS, ["@FeignClient"], [".java"])
    proto = native.proto(files).select("file", F.col("service").alias("client"), F.col("service").alias("interface"), "method", F.lit("").alias("http"), F.concat(F.lit("/"), "service", F.lit("/"), "method").alias("path"), "pos")
    return feign.unionByName(proto)


def frontend_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Calls of interfaces, routes with their full paths, stores and component contracts."""
    web = files.where(F.col("path").rlike(r"\.(vue|tsx?|jsx?)$"))
    raw = extract(web, code.routes, "file string, id string, parent string, path string, name string, component string, pos int", ["oute"])
    full = flatten(raw.select("id", "parent", "path")).select("id", F.col("path").alias("full_path"))
    props = extract(files, code.vue_contract, "file string, props array<string>, emits array<string>", suffixes=[".vue"])
    return {
        "packages": files_.packages(files),
        "api_clients": native.api_clients(files),
        "routes": raw.join(full, "id").select("file", "id", "parent", "full_path", "name", "component", "pos"),
        "stores": extract(web, code.stores, "file string, name string, store_id string, state array<string>, getters array<string>, actions array<string>, pos int", ["tore"]),
        "vue_contracts": props.join(native.vue_tags(files), "file", "left"),
    }


def path_rules(files: DataFrame) -> DataFrame:
    """(prefix, pattern, source, confidence, det_rank): what every detector finds in files."""
    return rules_.discover(files, native.yml_merged(native.yml(files)), native.starters(files))


def _ordered(found: DataFrame) -> Rules:
    """Rules for one CASE, those of better detectors first: a handful of rows."""
    order = [F.col(c) for c in ("det_rank", "pattern") if c in found.columns]
    return [(r["pattern"], r["prefix"]) for r in found.orderBy(*order).select("pattern", "prefix").collect()]


def _even(files: DataFrame) -> DataFrame:
    """files in parts of even size and no more than their bytes need: a scan has a part for every few files, and each extractor would run a task for it."""
    return files.hint("rebalance", "path")


def _build(store: Store, files: DataFrame, rules: Rules | None, embed: S.Embed | None, plugins: Sequence[Plugin]) -> None:
    """Every table of the knowledge base from one table of files; chunks whose text is known keep their vectors.

    rules: patterns and prefixes; None takes those found in the files with the store's manual ones in front. Tables
    that don't need each other are made side by side.
    """
    plugged = lambda phase: [p.scan(files) for p in plugins if p.phase == phase]
    more = lambda df, phase: R.union_all([df, *plugged(phase)])

    def put(name: str, df: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
        store.write(name, df, partition)
        return store.read(name)

    def wanted_rules() -> Rules:
        if rules is not None:
            return rules
        auto = put("auto_rules", path_rules(files))
        manual = store.read("manual_rules", "pattern string, prefix string")
        store.write_if_changed("path_rules_hash", rules_.rules_hash(put("path_rules", rules_.merge_manual(auto, manual))))
        return [*_ordered(manual), *_ordered(auto)]

    def put_entities(modules: DataFrame) -> DataFrame:
        fields, relations = entities(files, modules)
        store.write("relations", relations)
        return put("entity_fields", more(fields, "entity"))

    def put_flow(fields: DataFrame, remote: DataFrame) -> None:
        nodes, edges = flow_graph(files, fields, remote)
        store.write("flow_nodes", nodes)
        store.write("flow_edges", more(edges, "flow"))

    def put_frontend() -> None:
        for name, df in frontend_tables(files).items():
            store.write(name, df)

    def put_errors() -> None:
        parsers = {"java": (code.java_methods, ".java"), "go": (code.go_calls, ".go"), "python": (code.python_methods, ".py"), "routes": (code.routes, ".ts"), "yml": (code.yml_pairs, ".yml")}
        store.write("errors", R.union_all([extract(files, parse, "", suffixes=[suffix], errors=True).withColumn("parser", F.lit(name)) for name, (parse, suffix) in parsers.items()]))

    def put_cards(modules: DataFrame) -> None:
        by_hand = store.read("manual_cards", schemas.CARD)
        gone = store.read("removed_cards", "id string, source_path string")
        scanned = more(cards(files, modules), "asset").join(gone, "id", "left_anti")
        store.write("cards", R.prefer(by_hand, scanned.select(*by_hand.columns), ["id"]), ["scope"])

    def put_snapshot(modules: DataFrame) -> None:
        units = modules.select(F.col("slug").alias("unit"), "path")
        store.write("snapshot", files_.tracked(files, units, "path", "unit").unionByName(files_.hashes(files).select(F.lit("").alias("unit"), "path", "sha256")))

    together(
        store.spark,
        {
            "modules": ((), lambda: put("modules", files_.maven_modules(files))),
            "rules": ((), wanted_rules),
            "graphs": ((), lambda: (call_graph_java(files), call_graph_others(files), call_graph_frontend(files))),
            "rpcs": ((), lambda: put("rpcs", rpcs(files))),
            "frontend": ((), put_frontend),
            "entities": (("modules",), put_entities),
            "apis": (("modules", "rules"), lambda m, r: store.write("apis", more(apis(files, m, r), "api"))),
            "cards": (("modules",), put_cards),
            "call_edges": (("graphs",), lambda g: store.write("call_edges", R.union_all([edges for _, edges in g]))),
            "call_nodes": (("graphs", "modules"), lambda g, m: store.write("call_nodes", owned(R.union_all([nodes for nodes, _ in g]), m))),
            "flow": (("entities", "rpcs"), put_flow),
            "index": (("apis", "cards"), lambda *_: reindex(store, embed)),
            "snapshot": (("modules",), put_snapshot),
            "starters": ((), lambda: store.write("starters", native.starters(files))),
            "errors": ((), put_errors),
        },
    )


def reindex(store: Store, embed: S.Embed | None = None) -> None:
    """Chunks and the index follow cards and endpoints (M4, M8); texts that didn't change keep their vectors."""
    want = chunks(store.read("cards", schemas.CARD), store.read("apis", schemas.API))
    if store.exists("chunks"):
        old = store.read("chunks")
        same = want.join(old.select("id", "text", "embedding"), ["id", "text"])
        new = S.embed_table(want.join(old.select("id", "text"), ["id", "text"], "left_anti"), "text", embed)
        store.write("chunks", new.unionByName(same.select(*new.columns)))
    else:
        store.write("chunks", S.embed_table(want, "text", embed))
    store.write("index", index(store.read("chunks")))


def start_init(spark: SparkSession, root: str, out: str, rules: Rules | None = None, embed: S.Embed | None = None, plugins: Sequence[Plugin] = ()) -> Store:
    """Scans root and writes every table of the knowledge base to out (Q21): one file scan, shared by all extractors.

    The scan is written first, so that no extractor lists or reads the source tree again. Without rules those that
    the sources and the manual ones say are used.
    """
    store = Store(spark, out)
    store.write("files", _even(files_.scan(spark, root)))
    store.write("removed_cards", spark.createDataFrame([], "id string, source_path string"))
    _build(store, store.read("files"), rules, embed, plugins)
    return store


def documents(store: Store) -> DataFrame:
    """(path, markdown): endpoint tables by module and card sections by scope, module and kind."""
    api = markdown_table(store.read("apis"), ["module_slug"], {"method": "Method", "path": "Path", "summary": "Summary", "source": "Source"}, ["path", "method"], F.concat("module_slug", F.lit(" API")))
    card = markdown_sections(store.read("cards"), ["scope", "module_slug", "kind"], F.concat_ws(" ", "module_slug", "kind"))
    return api.select(F.concat(F.lit("backend/"), "module_slug", F.lit("/api.md")).alias("path"), "markdown").unionByName(card.select(F.concat(F.concat_ws("/", "scope", "module_slug", "kind"), F.lit(".md")).alias("path"), "markdown"))


def audit(spark: SparkSession, root: str, store: Store, since: str | None = None, paths: Sequence[str] = (), ignore: Sequence[str] = files_.IGNORED) -> DataFrame:
    """(path, bucket) of what changed since the last scan, or since a commit of the tree's git history (M5, Q10).

    paths keeps those only (none keeps all). Without a scan there is nothing to compare with, which raises.
    """
    if not store.exists("snapshot"):
        raise FileNotFoundError("no scan yet: run start_init first")
    return _buckets(spark, root, store, files_.rescan(spark, root, store.read("files")), since, paths, ignore)


def _buckets(spark: SparkSession, root: str, store: Store, now: DataFrame, since: str | None, paths: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    before = store.read("snapshot").where("unit = ''").select("path", "sha256")
    diff = R.snapshot_diff(before, files_.hashes(now), "path", "sha256")
    if since:
        changed = files_.git_changed(spark, re.sub(r"^file:/+", "/", root), since)
        diff = diff.where("status = 'deleted'").unionByName(now.select("path").join(changed, "path", "left_semi").select("path", F.lit("modified").alias("status")))
    indexed = store.read("cards").select(F.col("source_path").alias("path")).unionByName(store.read("apis").select(F.col("file").alias("path")))
    return classify(diff, indexed, "path", ignore, paths)


def sync(spark: SparkSession, root: str, store: Store, rules: Rules | None = None, dry_run: bool = False, embed: S.Embed | None = None, since: str | None = None, paths: Sequence[str] = (), plugins: Sequence[Plugin] = ()) -> DataFrame:
    """(path, bucket) of what changed since the last scan; unless dry, all tables are brought up to date (M5, M6, M7, M9, Q11).

    Of the tree only files with another size or time are read. If any changed, every table is made anew from the
    files as they are now, with paths from those alone and the others as they were, so graphs never mix two states;
    vectors of unchanged texts are kept. affected_units, written too, names the modules that hold a change.
    """
    found = audit(spark, root, store, since, paths)
    if dry_run:
        return found
    store.write("last_sync", found)  # the answer must not change when the tables below do
    found = store.read("last_sync")
    old, now = store.read("files"), files_.rescan(spark, root, store.read("files"))
    if paths:
        some = F.col("path").isin(list(paths))
        now = now.where(some).unionByName(old.where(~some).select(*now.columns))
    hashed = lambda df: files_.hashes(df)
    changed = R.snapshot_diff(hashed(old), hashed(now), "path", "sha256").where("status <> 'unchanged'").select("path")
    if changed.isEmpty():
        return found
    store.write("changed", changed)
    store.write("files", _even(now))
    # cards that were removed by hand come back when their file changes; those made by hand go with their file
    touched = store.read("changed").withColumnRenamed("path", "source_path")
    store.write("removed_cards", R.delete_ids(store.read("removed_cards", "id string, source_path string"), touched, ["source_path"]))
    lost = touched.join(store.read("files").select(F.col("path").alias("source_path")), "source_path", "left_anti")
    store.write("manual_cards", R.delete_ids(store.read("manual_cards", schemas.CARD), lost, ["source_path"]))
    files = store.read("files")
    _build(store, files, rules, embed, plugins)
    units = store.read("modules").select(F.concat(F.lit("/"), "path").alias("unit"))
    store.write("affected_units", affected_units(store.read("changed").select(F.concat(F.lit("/"), "path").alias("at")), "at", units, "unit"))
    return found
