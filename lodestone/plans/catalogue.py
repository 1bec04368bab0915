"""All queries of the engine by name, each with the SQL that DuckDB answers equally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph as G
from lodestone.operators import relational as R
from lodestone.operators import search as S
from lodestone.session import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    def of(table: str, kind: str, layer: str, key: str, name: str) -> DataFrame:
        return read(s, d, table).select(_id(kind, key).alias("id"), F.lit(layer).alias("layer"), F.col(name).cast("string").alias("name"))

    return R.union_all([of("part", "part", "entity", "p_partkey", "p_name"), of("supplier", "supplier", "repository", "s_suppkey", "s_name"), of("orders", "order", "service", "o_orderkey", "o_orderkey"), of("customer", "customer", "controller", "c_custkey", "c_name")])


def _edges(s: SparkSession, d: str, part: int | None = None) -> DataFrame:
    """All edges; with part only those of lineitem that touch it, so that the filter on the key reaches the scan."""
    line = read(s, d, "lineitem")
    line = line if part is None else line.where(F.col("l_partkey") == part)
    line = line.select("l_partkey", "l_suppkey", "l_orderkey", F.when(F.col("l_quantity") >= 25, "high").otherwise("low").alias("confidence"))
    part = _id("part", "l_partkey").alias("src")
    orders = read(s, d, "orders").select(_id("order", "o_orderkey").alias("src"), _id("customer", "o_custkey").alias("dst"), F.lit("high").alias("confidence"), F.lit("imports").alias("kind"))
    return R.union_all(
        [
            line.select(part, _id("supplier", "l_suppkey").alias("dst"), "confidence", F.lit("uses").alias("kind")),
            line.select(part, _id("order", "l_orderkey").alias("dst"), "confidence", F.lit("calls").alias("kind")),
            orders,
        ]
    )


NODES = """
nodes AS (
  SELECT 'part:' || p_partkey AS id, 'entity' AS layer, p_name AS name FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'repository', s_name FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'service', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'controller', c_name FROM customer)"""
EDGES = """
edges AS (
  SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, CASE WHEN l_quantity >= 25 THEN 'high' ELSE 'low' END AS confidence, 'uses' AS kind FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'order:' || l_orderkey, CASE WHEN l_quantity >= 25 THEN 'high' ELSE 'low' END, 'calls' FROM lineitem
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'high', 'imports' FROM orders)"""
NEAR = """
near AS (
  SELECT CASE WHEN src = 'part:1' THEN dst ELSE src END AS id, min(CASE confidence WHEN 'high' THEN 1 ELSE 2 END)::BIGINT AS confidence_rank
  FROM edges WHERE (src = 'part:1' OR dst = 'part:1') AND src <> dst GROUP BY 1),
found AS (SELECT near.id, layer, name, confidence_rank FROM near JOIN nodes USING (id))"""
LAYER_RANK = "CASE layer " + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(G.LAYERS)) + f" ELSE {len(G.LAYERS) + 1} END"


@query(f"""WITH {NODES}, {EDGES}, {NEAR}
SELECT layer, ({LAYER_RANK})::BIGINT AS layer_rank, count(*)::BIGINT AS n, count(*) FILTER (WHERE confidence_rank = 1)::BIGINT AS n_high,
  string_agg(name, ',' ORDER BY confidence_rank, name) AS names FROM found GROUP BY layer""")
def impact_layers(s, d):
    out = G.impact(_nodes(s, d), _edges(s, d, 1), "part:1")
    return out.select("layer", "layer_rank", "n", "n_high", F.array_join("names", ",").alias("names"))


@query(f"""WITH {NODES}, {EDGES}, {NEAR}
SELECT id, layer, name, confidence_rank, row_number() OVER (PARTITION BY layer ORDER BY confidence_rank, id) AS place FROM found""")
def impact_neighbors_ranked(s, d):
    w = Window.partitionBy("layer").orderBy("confidence_rank", "id")
    return G.neighbours(_nodes(s, d), _edges(s, d, 1), "part:1").withColumn("place", F.row_number().over(w).cast("bigint"))


@query(f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE src IN (SELECT 'part:' || p_partkey FROM part WHERE p_size = 1))
SELECT coalesce(o.id, i.id) AS id, coalesce(o.kind, i.kind) AS kind, coalesce(n_in, 0)::BIGINT AS n_in, coalesce(n_out, 0)::BIGINT AS n_out
FROM (SELECT src AS id, kind, count(*) AS n_out FROM e GROUP BY 1, 2) o
FULL JOIN (SELECT dst AS id, kind, count(*) AS n_in FROM e GROUP BY 1, 2) i ON o.id = i.id AND o.kind = i.kind""")
def callers_callees(s, d):
    seeds = read(s, d, "part").where("p_size = 1").select(_id("part", "p_partkey").alias("src"))
    return G.degrees(_edges(s, d).join(seeds, "src", "left_semi"))


@query("SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'steel')")
def graph_references(s, d):
    return G.references(read(s, d, "part").select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("name")), "steel")


@query("""SELECT sn.n_name AS src_repo, cn.n_name AS dst_repo, count(*)::BIGINT AS n FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
WHERE sn.n_name <> cn.n_name GROUP BY 1, 2""")
def cross_repo_edges(s, d):
    nation = read(s, d, "nation").select("n_nationkey", F.col("n_name").alias("repo"))
    # ends of one kind on each side, so their integer keys are ids enough: suppliers positive, customers negative
    home = lambda t, k, key, sign: read(s, d, t).join(nation, F.col(key) == nation["n_nationkey"]).select((F.col(k) * sign - int(sign < 0)).alias("id"), "repo")
    homes = home("supplier", "s_suppkey", "s_nationkey", 1).unionByName(home("customer", "c_custkey", "c_nationkey", -1))
    edges = read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("src"), (-F.col("o_custkey") - 1).alias("dst"))
    return G.across(edges, homes).groupBy("src_repo", "dst_repo").agg(F.count("*").alias("n"))


ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query(f"""SELECT l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {", ".join(ORD)}) = 1""")
def dedup_edges_first_wins(s, d):
    return R.first_wins(read(s, d, "lineitem").select(*ORD, "l_quantity"), ["l_partkey", "l_suppkey"], ORD).select("l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT user_id, event_type, event_id, value, overrides FROM (
  SELECT *, lag(value) OVER w AS overrides, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n = 1""")
def last_wins_override(s, d):
    e = read(s, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return R.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"], "value").select("user_id", "event_type", "event_id", "value", "overrides")


@query("""WITH a AS (SELECT s_nationkey AS k, s_name AS name, 'supplier' AS source FROM supplier WHERE s_suppkey <= 8)
SELECT * FROM a UNION ALL SELECT c_nationkey, c_name, 'customer' FROM customer WHERE c_nationkey NOT IN (SELECT k FROM a)""")
def merge_prefer_source(s, d):
    a = read(s, d, "supplier").where("s_suppkey <= 8").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"))
    b = read(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("source"))
    return R.prefer(a, b, ["k"])


@query("""WITH f AS (
  SELECT lower(p_brand) AS entity, p_type AS field, 1 AS rank, p_partkey AS ord, 'jpa' AS source FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT lower(p_brand), upper(p_type), 2, p_partkey, 'mybatis' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT lower(p_brand), p_name, 3, p_partkey, 'sql' FROM part),
m AS (SELECT *, row_number() OVER (PARTITION BY entity, lower(field) ORDER BY rank, ord) AS n FROM f)
SELECT entity, count(*)::BIGINT AS n_fields, string_agg(lower(field) || ':' || source, ',' ORDER BY lower(field) || ':' || source) AS fields FROM m WHERE n = 1 GROUP BY entity""")
def merge_entities_precedence(s, d):
    p = read(s, d, "part")
    one = lambda where, field, rank, source: p.where(where).select(F.lower("p_brand").alias("entity"), field.alias("field"), F.lit(rank).alias("rank"), F.col("p_partkey").alias("ord"), F.lit(source).alias("source"))
    fields = R.union_all([one("p_partkey % 2 = 0", F.col("p_type"), 1, "jpa"), one("p_partkey % 3 = 0", F.upper("p_type"), 2, "mybatis"), one("true", F.col("p_name"), 3, "sql")])
    merged = R.merge_ranked(fields, ["entity"], "field", "rank", ["ord"]).withColumn("text", F.concat(F.lower("field"), F.lit(":"), "source"))
    return merged.groupBy("entity").agg(F.count("*").alias("n_fields"), F.array_join(F.sort_array(F.collect_list("text")), ",").alias("fields"))


PATH = r"regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


def _path(c: str = "url"):
    return F.regexp_extract(c, r"^[a-z]+://[^/]+(/[^?#]*)", 1)


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM pages),
a AS (SELECT page_id, '/' || array_to_string(parts[1:n], '/') AS unit FROM (SELECT *, unnest(generate_series(1, greatest(len(parts), 1))) AS n FROM p)),
units AS (SELECT DISTINCT unit FROM a WHERE length(unit) - length(replace(unit, '/', '')) = 1)
SELECT unit, count(*)::BIGINT AS n_pages FROM a JOIN units USING (unit) GROUP BY unit""")
def prefix_unit_join(s, d):
    p = read(s, d, "pages").select("page_id", _path().alias("path"))
    units = p.select(F.element_at(R.ancestors(F.col("path")), 1).alias("unit")).distinct()
    return R.prefix_join(p, "path", units, "unit").groupBy("unit").agg(F.count("*").alias("n_pages"))


ANT = [("blog.**", "/blog"), ("m.**", "/mobile"), ("**.example.org", "/org"), ("**", "")]


@query(f"""SELECT page_id, host, prefix || path AS full_path FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {PATH} AS path,
    CASE WHEN regexp_matches(host, '^blog\\..*$') THEN '/blog' WHEN regexp_matches(host, '^m\\..*$') THEN '/mobile'
         WHEN regexp_matches(host, '^.*\\.example\\.org$') THEN '/org' ELSE '' END AS prefix FROM pages)""")
def ant_rule_prefix(s, d):
    p = read(s, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), _path().alias("path"))
    return R.ant_rules(p, "host", ANT).select("page_id", "host", F.concat("prefix", "path").alias("full_path"))


TERMS = ["the", "der", "que", "les"]


@query("""SELECT term, lang, count(*)::BIGINT AS n FROM (
  SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS term FROM documents) WHERE term IN ('the', 'der', 'que', 'les') GROUP BY 1, 2""")
def term_match_edges(s, d):
    terms = s.range(1).select(F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return R.term_join(read(s, d, "documents").select("doc_id", "lang", "text"), "text", terms, "term").groupBy("term", "lang").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, t.term FROM part JOIN (VALUES ('RED'), ('Blue'), ('green'), ('steel')) t(term) ON contains(lower(p_name), lower(t.term))")
def contains_ci_join(s, d):
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower("p_name"), F.lit(t.lower())), t) for t in ["RED", "Blue", "green", "steel"])))
    return read(s, d, "part").select("p_partkey", F.explode(hits).alias("term"))


@query("""WITH c AS (SELECT n_nationkey, unnest(['Customer#' || n_nationkey * 1000, 'Supplier#' || n_nationkey, 'Supplier#' || (n_nationkey % 7)]) AS name, unnest([0, 1, 2]) AS nth FROM nation),
known AS (SELECT 'Supplier#' || s_suppkey AS name, s_suppkey FROM supplier WHERE s_suppkey % 2 = 1)
SELECT n_nationkey, name, s_suppkey FROM c JOIN known USING (name) QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY nth) = 1""")
def candidate_priority_lookup(s, d):
    key = F.col("n_nationkey")
    options = F.array(F.concat(F.lit("Customer#"), (key * 1000).cast("string")), F.concat(F.lit("Supplier#"), key.cast("string")), F.concat(F.lit("Supplier#"), (key % 7).cast("string")))
    known = read(s, d, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("name"), "s_suppkey")
    return R.candidates(read(s, d, "nation").select("n_nationkey"), options, known, "name", ["n_nationkey"]).select("n_nationkey", "name", "s_suppkey")


@query("""SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def scope_asof_prefix(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return R.as_of(e.where("event_type = 'purchase'"), views, ["user_id"], "ts", "view_id", ["event_id"]).select("event_id", "user_id", "view_id")


@query("""WITH c AS (SELECT conv_id, turn, turn % 3 AS indent, role FROM conversations)
SELECT a.conv_id, a.turn, arg_max(b.turn, b.turn) AS scope FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.role = 'user' AND b.turn < a.turn AND b.indent < a.indent GROUP BY 1, 2""")
def enclosing_scope(s, d):
    c = read(s, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("indent"), "role").withColumn("name", F.col("turn"))
    return R.enclosing(c, ["conv_id"], "turn", "indent", "name", F.col("role") == "user").select("conv_id", "turn", "scope")


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM e)
SELECT user_id, event_type, island::BIGINT AS island, count(*)::BIGINT AS length, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id FROM i GROUP BY 1, 2, 3""")
def contiguous_blocks(s, d):
    e = R.islands(read(s, d, "events").select("user_id", "ts", "event_type", "event_id"), ["user_id"], ["ts"], "event_type")
    return e.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("length"), F.min_by("event_id", "ts").alias("first_id"), F.max_by("event_id", "ts").alias("last_id"))


URGENT = "o_orderpriority LIKE '1%'"


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND {URGENT})")
def anti_join_gaps(s, d):
    o = read(s, d, "orders").where(f"o_orderstatus = 'F' AND {URGENT}").select(F.col("o_custkey").alias("c_custkey"))
    return read(s, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query(f"""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND {URGENT}), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' AND {URGENT})
SELECT k::VARCHAR AS id, 'orphan_binding' AS kind FROM a WHERE k NOT IN (FROM b) UNION ALL SELECT k::VARCHAR, 'missing_binding' FROM b WHERE k NOT IN (FROM a)""")
def orphan_and_missing(s, d):
    from lodestone.sources.design import gaps

    o = read(s, d, "orders").where(URGENT).select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus")
    pages = s.createDataFrame([], "components array<string>")
    return gaps(pages, o.where("o_orderstatus = 'O'").select("id"), o.where("o_orderstatus = 'F'").select("id"))


@query("""WITH n AS (SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS plain FROM part),
v AS (SELECT term, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS bound FROM (VALUES ('red widget'), ('blue'), ('Steel'), ('tiny bolt'), ('large gear'), ('gear')) t(term)),
x AS (SELECT p_name, term, CASE WHEN p_name = term AND plain = bound THEN 100 WHEN plain = bound THEN 80
  WHEN ends_with(plain, bound) OR ends_with(bound, plain) THEN 40 WHEN contains(plain, bound) OR contains(bound, plain) THEN 30 ELSE 0 END AS score FROM n, v),
b AS (SELECT *, max(score) OVER (PARTITION BY p_name) AS best FROM x WHERE score > 0),
f AS (SELECT p_name, term, score, count(*) OVER (PARTITION BY p_name) AS ties FROM b WHERE score = best QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY term) = 1)
SELECT n.p_name AS name, term AS semantic_id, CASE WHEN score >= 80 THEN 'high' WHEN score IS NOT NULL THEN 'low' ELSE 'none' END AS confidence, coalesce(ties, 0)::BIGINT AS ties FROM n LEFT JOIN f USING (p_name)""")
def fuzzy_align_best(s, d):
    from lodestone.sources.design import align

    names = read(s, d, "part").select(F.lit("part").alias("package"), F.col("p_name").alias("name")).distinct()
    bound = s.range(1).select(F.explode(F.array(*map(F.lit, ["red widget", "blue", "Steel", "tiny bolt", "large gear", "gear"]))).alias("semantic_id"))
    return align(names, bound.withColumn("component", F.col("semantic_id"))).select("name", "semantic_id", "confidence", "ties")


@query(f"""WITH b AS (SELECT DISTINCT {PATH} AS path FROM pages WHERE page_id % 2 = 0), a AS (SELECT DISTINCT '/api' || {PATH} AS path FROM pages WHERE page_id % 3 = 0)
SELECT 'GET' AS method, b.path AS before, min(a.path) AS after FROM b JOIN a ON ends_with(a.path, b.path) AND a.path <> b.path GROUP BY b.path ORDER BY before LIMIT 5""")
def suffix_rename_samples(s, d):
    from lodestone.operators.rules import sample_changes

    p = read(s, d, "pages").select("page_id", F.lit("GET").alias("method"), _path().alias("path"))
    after = p.where("page_id % 3 = 0").withColumn("path", F.concat(F.lit("/api"), "path"))
    return sample_changes(p.where("page_id % 2 = 0"), after)


@query("""SELECT (SELECT count(*) FROM nation)::BIGINT AS modules, (SELECT count(*) FROM part)::BIGINT AS entities,
(SELECT count(*) FROM lineitem)::BIGINT AS edges, (SELECT count(*) FILTER (WHERE l_quantity >= 25) FROM lineitem)::BIGINT AS high_edges,
(SELECT count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders)::BIGINT AS done, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS repos,
(SELECT count(*) FILTER (WHERE role = 'assistant') FROM conversations)::BIGINT AS replies""")
def topology_counters(s, d):
    one = lambda t, **aggs: read(s, d, t).agg(*(c.alias(n) for n, c in aggs.items()))
    parts = [
        one("nation", modules=F.count("*")), one("part", entities=F.count("*")), one("lineitem", edges=F.count("*"), high_edges=F.count_if(F.col("l_quantity") >= 25)),
        one("orders", done=F.count_if(F.col("o_orderstatus") == "F")), one("documents", repos=F.count_distinct("source")), one("conversations", replies=F.count_if(F.col("role") == "assistant")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("""SELECT source, count(*) FILTER (WHERE lang = 'de')::BIGINT AS de, count(*) FILTER (WHERE lang = 'en')::BIGINT AS en,
count(*) FILTER (WHERE lang = 'es')::BIGINT AS es, count(*) FILTER (WHERE lang = 'fr')::BIGINT AS fr FROM documents GROUP BY source""")
def asset_counts_pivot(s, d):
    return read(s, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).fillna(0)


@query("""SELECT 'doc:' || doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[0-9]')))::BIGINT AS n FROM documents WHERE regexp_matches(text, '[0-9]')
UNION ALL SELECT 'page:' || page_id, len(regexp_extract_all(html, '<p|href='))::BIGINT FROM pages""")
def header_counts(s, d):
    docs = read(s, d, "documents").select(_id("doc", "doc_id").alias("id"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]"))).cast("bigint").alias("n")).where("n > 0")
    return docs.unionByName(read(s, d, "pages").select(_id("page", "page_id").alias("id"), F.regexp_count("html", F.lit("<p|href=")).cast("bigint").alias("n")))


@query("SELECT source, count(*)::BIGINT AS n, count(DISTINCT lang)::BIGINT AS langs FROM documents GROUP BY source")
def distinct_sources(s, d):
    return read(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_by_group(s, d):
    return read(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))


@query("""SELECT user_id, string_agg(event_type || '=' || v::VARCHAR, ',' ORDER BY event_type) AS merged FROM (
SELECT user_id, event_type, round(arg_max(value, ts) * 100)::BIGINT AS v FROM events GROUP BY 1, 2) GROUP BY user_id""")
def map_merge_last_wins(s, d):
    last = read(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.max_by("value", "ts") * 100).cast("bigint").alias("v"))
    text = F.concat("event_type", F.lit("="), F.col("v").cast("string"))
    return last.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("merged"))


@query("SELECT c_nationkey, sha256(string_agg(c_name, ',' ORDER BY c_name)) AS hash FROM customer GROUP BY c_nationkey")
def stable_list_hash(s, d):
    return read(s, d, "customer").groupBy("c_nationkey").agg(T.list_hash(F.collect_list("c_name")).alias("hash"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(s, d):
    return read(s, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def _snapshots(s, d):
    docs = read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.concat("text", F.lit("!")), 256).alias("h2"))
    return docs.where("doc_id % 7 <> 0").select("doc_id", "h"), docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.col("h2")).otherwise(F.col("h")).alias("h"))


SNAPSHOTS = """a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0),
x AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status
  FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


@query(f"WITH {SNAPSHOTS} SELECT status, count(*)::BIGINT AS n FROM x WHERE status <> 'unchanged' GROUP BY status")
def snapshot_diff(s, d):
    return R.snapshot_diff(*_snapshots(s, d), "doc_id", "h").where("status <> 'unchanged'").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o.event_id IS NULL THEN 'added' WHEN n.event_id IS NULL THEN 'deleted' WHEN abs(o.value - n.value) <= 0.5 THEN 'unchanged' ELSE 'modified' END AS status
FROM (SELECT * FROM events WHERE event_id % 9 <> 0) o FULL JOIN (SELECT event_id, value + event_id % 3 * 0.4 AS value FROM events WHERE event_id % 8 <> 0) n ON o.event_id = n.event_id) GROUP BY status""")
def snapshot_diff_epsilon(s, d):
    e = read(s, d, "events").select("event_id", "value")
    new = e.where("event_id % 8 <> 0").select("event_id", (F.col("value") + F.col("event_id") % 3 * F.lit(0.4)).alias("value"))
    return R.snapshot_diff(e.where("event_id % 9 <> 0"), new, "event_id", "value", 0.5).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT source FROM documents WHERE doc_id % 4 = 1")
def detect_new_units(s, d):
    docs = read(s, d, "documents").select("doc_id", "source")
    return R.new_units(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 4 = 1"), ["source"])


@query("SELECT 'customer' AS repo, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier")
def repo_union(s, d):
    one = lambda t, p: read(s, d, t).select(F.lit(t).alias("repo"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance"))
    return R.union_all([one("customer", "c"), one("supplier", "s")])


@query(f"""WITH {SNAPSHOTS}, i AS (SELECT DISTINCT doc_id FROM labels)
SELECT doc_id, CASE WHEN status = 'deleted' THEN 'deleted' WHEN i.doc_id IS NOT NULL THEN 'modified' ELSE 'unregistered' END AS bucket
FROM x LEFT JOIN i USING (doc_id) WHERE status <> 'unchanged' AND NOT (status = 'deleted' AND i.doc_id IS NULL)""")
def audit_classify(s, d):
    from lodestone.operators.audit import classify

    index = read(s, d, "labels").select("doc_id").distinct()
    return classify(R.snapshot_diff(*_snapshots(s, d), "doc_id", "h"), index, "doc_id")


@query("""WITH n AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 100 = 1)
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL FROM n""")
def upsert_by_id(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")).unionByName(o.where("o_orderkey % 100 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice"))
    return R.upsert(o, new, ["o_orderkey"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_name = 'red' OR starts_with(p_name, 'red '))")
def delete_by_prefix(s, d):
    return R.delete_prefix(read(s, d, "part").select("p_partkey", "p_name"), "p_name", "red", " ")


def _seed(s, d) -> list[float]:
    row = read(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"]) if row else [0.0]


COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 10")
def cosine_topk(s, d):
    return S.top_k(read(s, d, "embeddings"), "embedding", _seed(s, d), 10, "vec_id").select("vec_id", "score")


@query(f"SELECT e.vec_id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY score DESC, e.vec_id LIMIT 10")
def cosine_topk_kind(s, d):
    return S.top_k(read(s, d, "embeddings"), "embedding", _seed(s, d), 10, "vec_id", F.col("label") == 3).select("vec_id", "score")


SCORE = "CASE WHEN contains(lower({0}), '{1}') THEN 10 ELSE {2} END"


def _score(column: str, q: str) -> str:
    return SCORE.format(column, q, " + ".join(f"CASE WHEN contains(lower({column}), '{w}') THEN 2 ELSE 0 END" for w in q.split()))


@query(f"SELECT doc_id, ({_score('text', 'the anding')})::BIGINT AS score FROM documents WHERE ({_score('text', 'the anding')}) > 0 ORDER BY score DESC, doc_id LIMIT 10")
def keyword_score_topk(s, d):
    return S.keyword_top_k(read(s, d, "documents"), "text", "the anding", 10, "doc_id").select("doc_id", "score")


@query(f"""WITH k AS (SELECT p_partkey AS id, ({_score('p_name', 'gizmo quantum tiny')})::BIGINT AS score FROM part WHERE ({_score('p_name', 'gizmo quantum tiny')}) > 0 ORDER BY score DESC, id LIMIT 5),
v AS (SELECT e.vec_id AS id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 5),
u AS (SELECT id, score::DOUBLE AS score, 'keyword' AS via FROM k UNION ALL SELECT id, score * 10, 'vector' FROM v WHERE (SELECT coalesce(max(score), 0) FROM k) < 4 AND id NOT IN (SELECT id FROM k))
SELECT id, score, via FROM u ORDER BY score DESC, id LIMIT 5""")
def hybrid_search(s, d):
    words = S.keyword_top_k(read(s, d, "part").withColumnRenamed("p_partkey", "id"), "p_name", "gizmo quantum tiny", 5, "id").select("id", "score")
    vectors = S.top_k(read(s, d, "embeddings").withColumnRenamed("vec_id", "id"), "embedding", _seed(s, d), 5, "id").select("id", "score")
    return S.hybrid(words, vectors, 5, "id")


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS n_tokens, ceil(length(trim(text)) / 4) > 800 AS oversize FROM documents")
def token_estimate(s, d):
    return read(s, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"), (~T.fits(F.col("text"), 800)).alias("oversize"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(CASE WHEN doc_id % 2 = 0 THEN '# ' || text ELSE text END, '(?m)^#[ \t]+(.+)$', 1)), ''), source) AS title FROM documents""")
def local_single_chunk(s, d):
    md = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    return read(s, d, "documents").select("doc_id", T.chunk_title(md, F.concat(F.lit("docs/"), "source")).alias("title"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ps FROM documents),
f(doc_id, ps, i, buf, part, done) AS (
  SELECT doc_id, ps, 1, '', 0, NULL::VARCHAR FROM p
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN i > len(ps) THEN '' WHEN buf = '' THEN ps[i] WHEN length(buf) + 1 + length(ps[i]) <= 800 THEN buf || chr(10) || ps[i] ELSE ps[i] END,
    CASE WHEN i <= len(ps) AND buf <> '' AND length(buf) + 1 + length(ps[i]) > 800 THEN part + 1 ELSE part END,
    CASE WHEN i > len(ps) AND buf <> '' THEN buf WHEN i <= len(ps) AND buf <> '' AND length(buf) + 1 + length(ps[i]) > 800 THEN buf END
  FROM f WHERE i <= len(ps) + 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS part, done AS chunk FROM f WHERE done IS NOT NULL""")
def style_chunks(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(S.pack_paragraphs(F.col("text"))).alias("part", "chunk"))


@query("""WITH n AS (SELECT doc_id, text, (1 << least(5, greatest(0, ceil(log2(ceil(length(text) / 4) / 800))))::INTEGER)::INTEGER AS pieces FROM documents WHERE length(text) > 0),
c AS (SELECT *, greatest(ceil(length(text) / pieces), 1)::INTEGER AS size FROM n),
x AS (SELECT doc_id, i, substr(text, i * size + 1, size) AS text FROM (SELECT *, unnest(generate_series(0, pieces - 1))::INTEGER AS i FROM c))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS part, text FROM x WHERE text <> ''""")
def oversized_split(s, d):
    return S.split_oversized(read(s, d, "documents").select("doc_id", "text"), "text", 800)


@query("""SELECT sha256('part|' || p_partkey || '|' || p_name) AS chunk_id, 'component' AS kind, 'component: ' || p_name || chr(10) || p_type AS text FROM part
UNION ALL SELECT sha256('supplier|' || s_suppkey || '|' || s_name), 'rpc', 'rpc: ' || s_name FROM supplier""")
def structured_chunks(s, d):
    none = F.array().cast("array<string>")
    p = read(s, d, "part").select(S.chunk_id(F.lit("part"), F.col("p_partkey").cast("string"), F.col("p_name")).alias("chunk_id"), F.lit("component").alias("kind"), T.asset_text(F.lit("component"), F.col("p_name"), F.col("p_type"), none).alias("text"))
    u = read(s, d, "supplier").select(S.chunk_id(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.col("s_name")).alias("chunk_id"), F.lit("rpc").alias("kind"), T.asset_text(F.lit("rpc"), F.col("s_name"), F.lit(None).cast("string"), none).alias("text"))
    return p.unionByName(u)


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 10)::BIGINT AS batch FROM customer")
def batch_assignment(s, d):
    return R.batches(read(s, d, "customer").select("c_custkey"), "c_custkey", 10)


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END, '<[^>]*>', '', 'g')), ''),
  nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), ''), 'page-' || page_id) AS title,
  len(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1)))::BIGINT AS n_links,
  len(regexp_extract_all(regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1), 'href='))::BIGINT AS n_nav FROM pages""")
def html_title_regions(s, d):
    html = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "(?is)<title[^>]*>.*?</title>", "")).otherwise(F.col("html"))
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))).cast("bigint")
    nav = F.regexp_count(F.regexp_extract("html", "(?is)<nav>(.*?)</nav>", 1), F.lit("href=")).cast("bigint")
    return read(s, d, "pages").select("page_id", T.html_title(html, _id("page", "page_id")).alias("title"), links.alias("n_links"), nav.alias("n_nav")).withColumn("title", F.regexp_replace("title", "^page:", "page-"))


@query(r"""WITH c AS (SELECT doc_id, string_split(string_split(text, chr(10))[1] || chr(10) || '.a { color: #' || lpad(lower(hex(doc_id % 4096)), 3, '0') || '; margin: ' || (doc_id % 7) || 'px }', chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM c),
h AS (SELECT doc_id, n, 'hex' AS kind, unnest(regexp_extract_all(line, '#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3})(?:$|[^0-9a-zA-Z])')) AS hit FROM l
  UNION ALL SELECT doc_id, n, 'px', unnest(regexp_extract_all(line, ' [0-9]+px')) FROM l)
SELECT 'd' || doc_id || '.css' AS path, n::INTEGER AS line, kind, trim(regexp_replace(hit, '[^0-9a-zA-Z#]$', '')) AS match FROM h WHERE trim(hit) NOT IN ('0px', '1px')""")
def line_violations(s, d):
    from lodestone.sources.design import violations

    rule = F.concat(F.lit(".a { color: #"), F.lpad(F.lower(F.hex(F.col("doc_id") % 4096)), 3, "0"), F.lit("; margin: "), (F.col("doc_id") % 7).cast("string"), F.lit("px }"))
    sheet = F.concat_ws("\n", F.element_at(F.split("text", "\n"), 1), rule)
    return violations(read(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".css")).alias("path"), sheet.alias("content")))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue|green)') THEN 'colors' WHEN regexp_matches(p_name, 'bolt|gear') THEN 'hardware' WHEN regexp_matches(p_name, '^.{1,9}$') THEN 'short' ELSE 'other' END AS bucket FROM part")
def token_buckets(s, d):
    rules = [("^(red|blue|green)", "colors"), ("bolt|gear", "hardware"), ("^.{1,9}$", "short")]
    return read(s, d, "part").select("p_partkey", T.ordered_bucket(F.col("p_name"), rules).alias("bucket"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(lower(p_name), '[^a-z0-9-]', '-', 'g') AS slug_each FROM part")
def slugify_names(s, d):
    return read(s, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.slug_each(F.col("p_name")).alias("slug_each"))


@query(f"SELECT page_id, regexp_replace(regexp_replace('/api//' || {PATH}, '/+', '/', 'g'), '/$', '') AS path FROM pages")
def normalize_paths(s, d):
    return read(s, d, "pages").select("page_id", T.join_path(F.lit("api/"), _path()).alias("path"))


@query("""SELECT event_id, k.key AS key, json_extract_string(props, '$.' || k.key) AS value FROM events, unnest(json_keys(props)) AS k(key)""")
def json_props(s, d):
    return read(s, d, "events").select("event_id", F.explode(T.flat_json(F.col("props"))).alias("p")).select("event_id", "p.key", "p.value")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:2], chr(10)) AS section FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def section_extract(s, d):
    lines = F.split("text", "\n")
    md = F.concat_ws("\n", F.transform(lines, lambda x, i: F.concat(F.lit("## s"), i.cast("string"), F.lit("\n"), x)))
    body = T.section(md, F.lit("s1"))
    return read(s, d, "documents").select("doc_id", F.regexp_replace(body, "^## s1\n", "").alias("section")).where("section IS NOT NULL")


@query("SELECT '/' || lower(r_name) || '/' || lower(n_name) || '/' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def route_flatten_recursive(s, d):
    rows = [
        read(s, d, "region").select(_id("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lower("r_name").alias("path")),
        read(s, d, "nation").select(_id("n", "n_nationkey").alias("id"), _id("r", "n_regionkey").alias("parent"), F.lower("n_name").alias("path")),
        read(s, d, "customer").select(_id("c", "c_custkey").alias("id"), _id("n", "c_nationkey").alias("parent"), F.col("c_custkey").cast("string").alias("path")),
    ]
    from lodestone.operators.tree import flatten

    return flatten(R.union_all(rows)).where(F.startswith("id", F.lit("c:"))).select("path")


@query("""WITH c AS (SELECT lower(r_name) || '/' || lower(n_name) AS path, r_name, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT lower(r_name) AS path, 'scope' AS kind, NULL AS parent, string_agg(DISTINCT path, ',' ORDER BY path) AS children, 0::BIGINT AS n_chunks FROM c GROUP BY 1
UNION ALL SELECT path, 'module', lower(min(r_name)), '', count(*)::BIGINT FROM c GROUP BY path""")
def tree_children(s, d):
    from lodestone.plans.knowledge import index

    n = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(read(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    chunks = n.select(F.concat_ws("/", F.lower("r_name"), F.lower("n_name")).alias("path"), F.col("c_custkey").cast("string").alias("id"))
    return index(chunks).select("path", "kind", "parent", F.array_join("children", ",").alias("children"), F.size("chunks").cast("bigint").alias("n_chunks"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'high' WHEN n_chars > 3200 THEN 'medium' WHEN contains(lower(text), 'license') THEN 'medium' ELSE 'low' END AS risk FROM documents")
def risk_rules(s, d):
    from lodestone.operators.status import risk

    return read(s, d, "documents").select("doc_id", risk(F.col("text"), F.col("n_chars"), ["license"], 3200).alias("risk"))


@query("""WITH f AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN 'g' END AS goal, CASE WHEN user_id % 3 <> 0 THEN 's' END AS spec, CASE WHEN user_id % 7 = 0 THEN 'high' ELSE 'low' END AS risk,
  CASE WHEN user_id % 4 <> 0 THEN 'approved' END AS approval, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS done FROM events GROUP BY user_id),
p AS (SELECT *, CASE WHEN user_id % 11 = 0 THEN 'blocked' WHEN spec IS NULL AND goal IS NULL AND total % 2 = 1 THEN 'idle' WHEN risk = 'high' AND approval IS NULL THEN 'spec_pending_approval'
  WHEN spec IS NOT NULL AND approval IS NULL THEN 'brainstorming' WHEN done < total THEN 'implementing' WHEN user_id % 2 = 0 THEN 'verifying'
  WHEN goal IS NOT NULL AND total % 2 = 0 THEN 'done' ELSE 'idle' END AS phase FROM f)
SELECT user_id, phase, CASE phase WHEN 'blocked' THEN 'start_init' WHEN 'done' THEN 'none' WHEN 'spec_pending_approval' THEN 'await_spec_approval' WHEN 'verifying' THEN 'finish_feature' WHEN 'implementing' THEN 'implement_plan'
  WHEN 'brainstorming' THEN 'plan_from_spec' ELSE CASE WHEN goal IS NULL THEN 'none' ELSE 'auto_brainstorm' END END AS next_action FROM p""")
def status_phase(s, d):
    from lodestone.operators.status import phase

    u, null = F.col("user_id"), F.lit(None).cast("string")
    when = lambda test, value, other=null: F.when(test, F.lit(value)).otherwise(other)
    f = read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("done"))
    f = f.select(
        "user_id", "total", "done", when(u % 5 != 0, "g").alias("goal"), when(u % 3 != 0, "s").alias("spec"), when(F.col("total") % 2 == 0, "p").alias("plan"), when(u % 7 == 0, "high", F.lit("low")).alias("risk"), when(u % 4 != 0, "approved").alias("approval"),
        when(u % 2 == 0, "FAIL", F.lit("PASS")).alias("verdict"), F.lit(0).cast("bigint").alias("findings"), F.lit(0).cast("bigint").alias("blockers"), F.lit(True).alias("db_present"), (u % 11 != 0).alias("scan_present"),
    )
    return phase(f).select("user_id", "phase", "next_action")


@query("""SELECT o_custkey, count(*)::BIGINT AS total, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS done, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS blocked, bool_and(o_orderstatus = 'F') AS all_done, false AS drift FROM orders GROUP BY o_custkey""")
def task_ledger(s, d):
    from lodestone.operators.status import ledger

    mark = F.when(F.col("o_orderstatus") == "F", "- [x] ").when(F.col("o_orderstatus") == "P", "* [!] ").otherwise("- [ ] ")
    lists = read(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(mark, F.col("o_orderkey").cast("string"))), "\n").alias("text"))
    return ledger(lists, "o_custkey", "text")


@query("""SELECT 'part' AS matched_in, p_name AS name FROM part WHERE p_name ILIKE '%red%' UNION ALL SELECT 'nation', n_name FROM nation WHERE n_name ILIKE '%red%'
UNION ALL SELECT 'page', url FROM pages WHERE url ILIKE '%red%' UNION ALL SELECT 'customer', c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%red%'""")
def topic_drilldown(s, d):
    one = lambda t, c, label: read(s, d, t).where(F.col(c).ilike("%red%")).select(F.lit(label).alias("matched_in"), F.col(c).alias("name"))
    return R.union_all([one("part", "p_name", "part"), one("nation", "n_name", "nation"), one("pages", "url", "page"), one("customer", "c_mktsegment", "customer")])
