"""Extractors that regular expressions and JSON functions in the JVM can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ("get", "post", "put", "delete", "patch")


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def openapi(files: DataFrame) -> DataFrame:
    """Endpoints of OpenAPI documents (S3), plain or wrapped in "data"; the module is the file's directory."""
    verb = "struct<summary:string,operationId:string,tags:array<string>>"
    doc = f"paths map<string,map<string,{verb}>>, data struct<openapi:string,paths:map<string,map<string,{verb}>>>, openapi string, swagger string"
    parsed = files.where(F.endswith("path", F.lit(".json")) & F.contains("content", F.lit('"paths"'))).select(F.col("path").alias("file"), F.from_json("content", doc).alias("d"))
    paths = parsed.select("file", F.explode(F.coalesce("d.paths", "d.data.paths")).alias("path", "verbs"))
    each = paths.select("file", "path", F.explode("verbs").alias("verb", "op")).where(F.lower("verb").isin(*VERBS))
    method, parts = F.upper("verb"), F.split("file", "/")
    module = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("root")
    tags = F.coalesce(F.col("op.tags"), F.array().cast("array<string>"))
    return each.select(
        F.concat(method, F.lit("-"), "path").alias("id"), method.alias("method"), "path", F.coalesce(_blank(F.col("op.summary")), _blank(F.col("op.operationId")), F.col("path")).alias("summary"), tags.alias("tags"),
        F.when(F.contains("path", F.lit("/internal")), "internal").otherwise("public").alias("audience"), F.lit("openapi").alias("source"), F.lower(module).alias("module_slug"), "file", F.lit(0).alias("pos"),
    )


def sql_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, relations) of CREATE TABLE statements (S10): table, name, type, nullable, pos; src, dst, kind, field."""
    sql = files.where(F.endswith("path", F.lit(".sql")))
    head = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(?:\w+[`\"]?\.[`\"]?)?(\w+)[`\"]?\s*\((.*?)\)\s*(?:[^();,]*)?;"
    tables = sql.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(head), 0)).alias("stmt"))
    tables = tables.select("file", F.regexp_extract("stmt", head, 1).alias("table"), F.regexp_extract("stmt", head, 2).alias("body"))
    lines = tables.select("file", "table", F.posexplode(F.split("body", r",?\s*\r?\n|,(?![^(]*\))")).alias("pos", "line")).select("file", "table", "pos", F.trim("line").alias("line"))
    reserved = r"(?i)^(primary|foreign|unique|key|index|constraint|check|--|/\*|$)"
    column = r"^[`\"]?(\w+)[`\"]?\s+([A-Za-z]+(?:\s*\([^)]*\))?)"
    cols = lines.where(~F.col("line").rlike(reserved) & F.col("line").rlike(column)).select(
        "file", "table", F.regexp_extract("line", column, 1).alias("name"), F.upper(F.regexp_replace(F.regexp_extract("line", column, 2), r"\s+", "")).alias("type"),
        (~F.col("line").rlike(r"(?i)not\s+null|primary\s+key")).alias("nullable"), "pos",
    )
    foreign = r"(?i)foreign\s+key\s*\(\s*[`\"]?(\w+)[`\"]?\s*\)\s*references\s+[`\"]?(\w+)"
    rel = lines.where(F.col("line").rlike(foreign)).select(F.col("table").alias("src"), F.regexp_extract("line", foreign, 2).alias("dst"), F.lit("many-to-one").alias("kind"), F.regexp_extract("line", foreign, 1).alias("field"), F.lit("sql").alias("source"), "file", "pos")
    return cols, rel


def proto(files: DataFrame) -> DataFrame:
    """(file, service, method, request, response) of proto services (S13); streams count as what they carry."""
    bare = F.regexp_replace("content", r"(?s)//[^\n]*|/\*.*?\*/", "")
    service, call = r"(?s)service\s+(\w+)\s*\{((?:[^{}]|\{[^{}]*\})*)\}", r"(?s)\brpc\b([^(]*)\(([^)]*)\)[^(;{]*\(([^)]*)\)"
    found = files.where(F.endswith("path", F.lit(".proto"))).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(bare, F.lit(service), 0)).alias("s"))
    each = found.select("file", F.regexp_extract("s", service, 1).alias("service"), F.posexplode(F.regexp_extract_all("s", F.lit(call), 0)).alias("pos", "r"))
    word = lambda i: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("r", call, i), r"\s+", " ")), "^stream ", "")
    return each.select("file", "service", word(1).alias("method"), word(2).alias("request"), word(3).alias("response"), "pos")


def mybatis(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, relations) of MyBatis resultMaps (S9): entity, name, column; an association is many-to-one, a collection one-to-many."""
    attr = lambda c, a: F.nullif(F.regexp_extract(c, rf"\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    simple = lambda c: F.element_at(F.split(c, r"[.$]"), -1)
    maps = files.where(F.endswith("path", F.lit(".xml")) & F.contains("content", F.lit("<resultMap"))).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<resultMap\b.*?</resultMap>"), 0)).alias("m"))
    maps = maps.select("file", "m", simple(attr(F.regexp_extract("m", r"(?s)^<resultMap\b[^>]*>", 0), "type")).alias("entity")).where("entity IS NOT NULL")
    tag = lambda names: F.posexplode(F.regexp_extract_all("m", F.lit(rf"<(?:{names})\b[^>]*>"), 0)).alias("pos", "t")
    fields = maps.select("file", "entity", tag("id|result")).select("file", "entity", attr(F.col("t"), "property").alias("name"), attr(F.col("t"), "column").alias("column"), "pos")
    kind = F.when(F.startswith("t", F.lit("<association")), "many-to-one").otherwise("one-to-many")
    target = F.coalesce(attr(F.col("t"), "ofType"), attr(F.col("t"), "javaType"))
    rel = maps.select("file", "entity", tag("association|collection")).select(F.col("entity").alias("src"), simple(target).alias("dst"), kind.alias("kind"), attr(F.col("t"), "property").alias("field"), F.lit("mybatis").alias("source"), "file", "pos")
    return fields, rel.where("dst IS NOT NULL")


def ts_exports(files: DataFrame) -> DataFrame:
    """(file, kind, name, pos) of a TypeScript file's exports (S15): component, enum or util."""
    code = r"export\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:const\s+(?=enum))?(enum|function|class|const|let|interface|type)\s+([A-Za-z_$][\w$]*)"
    found = files.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|vue)$")).select(F.col("path").alias("file"), F.posexplode(F.regexp_extract_all("content", F.lit(code), 0)).alias("pos", "e"))
    what, name = F.regexp_extract("e", code, 1), F.regexp_extract("e", code, 2)
    is_component = F.col("file").rlike(r"\.(vue|tsx|jsx)$") & name.rlike("^[A-Z]") & what.isin("function", "class", "const")
    return found.select("file", F.when(what == "enum", "enum").when(is_component, "component").otherwise("util").alias("kind"), name.alias("name"), "pos").dropDuplicates(["file", "kind", "name"])


def ts_docs(files: DataFrame, cap: int = 20) -> DataFrame:
    """(file, description, signatures) (S16): the first JSDoc's first line and at most cap export lines."""
    doc = _blank(F.regexp_replace(F.regexp_extract("content", r"(?s)/\*\*(.*?)\*/", 1), r"(?m)^\s*\*\s?", ""))
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: x.rlike(r"^export\s"))
    first = _blank(F.element_at(F.filter(F.split(doc, "\n"), lambda x: F.trim(x) != ""), 1))
    return files.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|vue)$")).select(F.col("path").alias("file"), F.when(doc.isNotNull(), first).alias("description"), F.transform(F.slice(lines, 1, cap), lambda x: F.regexp_replace(F.trim(x), r"\s*[{=].*$", "")).alias("signatures"))


def api_clients(files: DataFrame) -> DataFrame:
    """(file, method, path) of request calls in api files (S17), distinct."""
    call = r"(?i)\b(?:request|http|axios|api|client)\s*\.\s*(get|post|put|delete|patch)\s*(?:<[^>]*>)?\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"
    options = r"(?is)\burl\s*:\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*method\s*:\s*[\"'`](get|post|put|delete|patch)[\"'`]"
    is_api = F.col("path").rlike(r"(?i)(^|/)(api|apis|services?)/.*\.(ts|js)$|\.api\.(ts|js)$")
    some = files.where(is_api).select(F.col("path").alias("file"), "content")
    pick = lambda p, m, u: some.select("file", F.explode(F.regexp_extract_all("content", F.lit(p), 0)).alias("c")).select("file", F.upper(F.regexp_extract("c", p, m)).alias("method"), F.regexp_replace(F.regexp_extract("c", p, u), r"\$\{([^}]*)\}", "{$1}").alias("path"))
    return pick(call, 1, 2).unionByName(pick(options, 2, 1)).distinct()


#: Tags that are HTML's own.
HTML_TAGS = "a abbr article aside audio b blockquote body br button canvas caption code col dd div dl dt em fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label legend li link main meta nav ol option p pre section select slot small span strong style sub sup svg table tbody td template textarea tfoot th thead title tr u ul video script component transition keep-alive router-view router-link path".split()


def vue_tags(files: DataFrame) -> DataFrame:
    """(file, tags) of the components a Vue template uses (S20), sorted; kebab-case names become PascalCase."""
    body = F.regexp_extract("content", r"(?s)<template\b[^>]*>(.*)</template>", 1)
    tags = F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(r"<([A-Za-z][\w-]*)"), 1)), F.array(*map(F.lit, HTML_TAGS)))
    pascal = F.transform(tags, lambda t: F.array_join(F.transform(F.split(t, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), ""))
    return files.where(F.endswith("path", F.lit(".vue"))).select(F.col("path").alias("file"), F.array_sort(F.array_distinct(pascal)).alias("tags"))


def java_kinds(files: DataFrame) -> DataFrame:
    """(file, kind, name) of reusable Java files (S21): enum, then rpc, util, pojo; the first rule counts."""
    c, p = F.col("content"), F.col("path")
    kind = (
        F.when(c.rlike(r"\benum\s+\w+\s*(implements\b[^{]*)?\{"), "enum")
        .when(c.rlike(r"@FeignClient\b|@DubboService\b"), "rpc")
        .when(p.rlike(r"(?i)utils?\.java$"), "util")
        .when(p.rlike(r"(DTO|VO|BO|DO|Req|Resp|Request|Response)\.java$"), "pojo")
        .when(F.contains(F.lower(p), F.lit("/util/")), "util")
    )
    from lodestone.functions.text import class_name

    return files.where(F.endswith(p, F.lit(".java"))).select(p.alias("file"), kind.alias("kind"), class_name(c).alias("name")).where("kind IS NOT NULL AND name IS NOT NULL")


def starters(files: DataFrame) -> DataFrame:
    """(module, autoconfigs) of starter modules (S22): classes in AutoConfiguration.imports and spring.factories, distinct and sorted."""
    imports = F.endswith("path", F.lit("AutoConfiguration.imports"))
    factories = F.endswith("path", F.lit("spring.factories"))
    joined = F.regexp_replace("content", r"\\\s*\r?\n\s*", "")
    value = F.regexp_extract(joined, r"(?m)EnableAutoConfiguration\s*=\s*(.*)$", 1)
    names = F.when(imports, F.split("content", r"\r?\n")).otherwise(F.split(value, ","))
    clean = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    module = F.regexp_extract("path", r"^(.*?)/?src/main/resources/", 1)
    return files.where(imports | factories).select(module.alias("module"), F.explode(clean).alias("c")).groupBy("module").agg(F.array_sort(F.collect_set("c")).alias("autoconfigs"))


def frontend_kind(path: Column, content: Column) -> Column:
    """vue, then store, api-client, route, component, util."""
    return (
        F.when(F.endswith(path, F.lit(".vue")), "component")
        .when(content.rlike(r"\bdefineStore\s*\(|\bcreateStore\s*\(|new\s+Vuex\.Store"), "store")
        .when(path.rlike(r"(?i)(^|/)(api|apis)/.*\.(ts|js)$"), "api-client")
        .when(content.rlike(r"\bcreateRouter\s*\(|RouteRecordRaw|<Route\b|createBrowserRouter"), "route")
        .when(path.rlike(r"\.(tsx|jsx)$"), "component")
        .when(path.rlike(r"\.(ts|js)$"), "util")
    )


def yml(files: DataFrame, cap: int = 20) -> DataFrame:
    """(file, key, value) of application*.yml (S28): dotted keys of the first cap files by path; parents by indent."""
    from lodestone.sources.code import yml_pairs
    from lodestone.sources.files import extract

    some = files.where(F.col("path").rlike(r"(^|/)application[^/]*\.ya?ml$")).orderBy("path").limit(cap)
    return extract(some, yml_pairs, "file string, pos int, key string, value string")


def yml_merged(pairs: DataFrame) -> DataFrame:
    """(key, value): a later file's value wins, and a later line's inside a file."""
    return pairs.groupBy("key").agg(F.max_by("value", F.struct("file", "pos")).alias("value"))


def pipe_table(files: DataFrame, columns: int) -> DataFrame:
    """(file, pos, cells) of the rows of Markdown tables (S32), without head rules and heads."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    from pyspark.sql import Window

    nxt = F.lead("line").over(Window.partitionBy("file").orderBy("pos"))
    rule = r"^\s*\|[\s:|-]+\|\s*$"
    body = lines.withColumn("_next", nxt).where(~F.col("line").rlike(rule) & ~F.coalesce(F.col("_next").rlike(rule), F.lit(False)))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return body.select("file", "pos", cells.alias("cells")).where(F.size("cells") >= columns)


def log_status(files: DataFrame, terms: list[str], last: str) -> DataFrame:
    """A column per term with its number of hits, and last_match, the last match of a pattern."""
    found = F.regexp_extract_all("content", F.lit(last), 0)
    return files.select(F.col("path").alias("file"), *(F.regexp_count("content", F.lit(r"\Q" + t + r"\E")).alias(t) for t in terms), F.when(F.size(found) > 0, F.element_at(found, -1)).alias("last_match"))
