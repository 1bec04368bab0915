"""Relational, graph, search, state and rule operators on small tables, whatever the order of rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import audit, graph, relational as R, rules, search, status
from lodestone.shared import together
from lodestone.sources.store import Store, markdown_table
from tests.helpers import rows


def shuffled(spark, data, schema, seed=0):
    data = list(data)
    random.Random(seed).shuffle(data)
    return spark.createDataFrame(data, schema).repartition(3)


def test_first_and_last_wins_do_not_depend_on_row_order(spark):
    data = [("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), ("a", 3, "w")]
    for seed in range(3):
        df = shuffled(spark, data, "k string, n int, v string", seed)
        assert rows(R.first_wins(df, ["k"], ["n"])) == [("a", 1, "x"), ("b", 5, "z")]
        assert rows(R.last_wins(df, ["k"], ["n"], "v")) == [("a", 3, "w", "y"), ("b", 5, "z", None)]


def test_ant_patterns():
    import re

    fits = lambda p, n: bool(re.match(R.ant_regex(p), n))
    assert fits("**.controller.admin.**", "com.example.controller.admin.user") and not fits("**.controller.app.**", "x.controller.admin.y")
    assert not fits("**.controller.admin.**", "controller.admin.user") and not fits("com.*.api", "com.x.y.api") and fits("com.*.api", "com.x.api")
    assert not fits("com.**.api", "com.api") and fits("**", "anything")


def test_prefix_delete_spares_siblings(spark):
    df = spark.createDataFrame([("backend/auth",), ("backend/auth/x",), ("backend/auth-starter",), ("backend/auth_x",), (None,)], "path string")
    assert rows(R.delete_prefix(df, "path", "backend/auth")) == sorted([("backend/auth-starter",), ("backend/auth_x",), (None,)], key=repr)


def test_ancestors_join_and_owner(spark):
    df = spark.createDataFrame([("/a/b/c.java",), ("/ab/x.java",), ("/",)], "path string")
    units = spark.createDataFrame([("/a",), ("/a/b",)], "unit string")
    assert rows(R.prefix_join(df, "path", units, "unit")) == [("/a/b/c.java", "/a"), ("/a/b/c.java", "/a/b")]
    assert rows(R.owner(df, "path", units, "unit", ["path"])) == [("/a/b/c.java", "/a/b")]


def test_terms_match_whole_words_only(spark):
    df = spark.createDataFrame([(1, "the Order item"), (2, "Orders"), (3, "order"), (4, "x.Order;"), (5, "Orderü"), (6, None)], "id int, text string")
    terms = spark.createDataFrame([("Order",)], "term string")
    assert rows(R.term_join(df, "text", terms, "term").select("id")) == [(1,), (4,), (5,)]
    assert rows(R.phrase_join(df, "text", ["Order item", "Order"]).select("id", "term")) == [(1, "Order item"), (1, "Order"), (4, "Order"), (5, "Order")]


def test_as_of_and_islands(spark):
    left, right = spark.createDataFrame([(1, 5, 10), (1, 1, 11), (2, 9, 12)], "k int, at int, id int"), spark.createDataFrame([(1, 2, "p"), (1, 5, "q"), (1, 6, "r")], "k int, at int, v string")
    assert rows(R.as_of(left, right, ["k"], "at", "v", ["id"]).select("id", "v")) == [(10, "q"), (11, None), (12, None)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabba")], "k int, at int, v string")
    assert [r["island"] for r in R.islands(df, ["k"], ["at"], "v").orderBy("at").collect()] == [1, 1, 2, 2, 3]


def test_snapshot_diffs(spark):
    old, new = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "p string, m double"), spark.createDataFrame([("a", 1.4), ("b", 2.6), ("d", 1.0)], "p string, m double")
    assert rows(R.snapshot_diff(old, new, "p", "m", 0.5)) == [("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")]
    index = spark.createDataFrame([("a",), ("c",)], "p string")
    assert rows(audit.classify(R.snapshot_diff(old, new, "p", "m"), index, "p")) == [("a", "modified"), ("b", "unregistered"), ("c", "deleted"), ("d", "unregistered")]


def test_impact_by_layer_and_confidence(spark):
    nodes = spark.createDataFrame([("entity:Order", "entity", "Order"), ("s", "service", "OrderService"), ("r", "repository", "Low"), ("q", "repository", "High")], "id string, layer string, name string")
    edges = spark.createDataFrame([("entity:Order", "r", "low"), ("entity:Order", "q", "high"), ("entity:Order", "s", "high"), ("s", "entity:Order", "low"), ("entity:Order", "gone", "high")], "src string, dst string, confidence string")
    got = {r["layer"]: (r["n"], r["n_high"], r["names"]) for r in graph.impact(nodes, edges, "entity:Order").collect()}
    assert got == {"repository": (2, 1, ["High", "Low"]), "service": (1, 1, ["OrderService"])}
    assert not rows(graph.impact(nodes, edges, "entity:None"))


def test_calls_and_cross_repo(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("a", "d", "uses")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("a", "A.f"), ("b", "B.g")], "id string, name string")
    assert rows(graph.directed(nodes, edges, "b", "calls", True)) == [("a", "A.f")] and rows(graph.directed(nodes, edges, "b", "calls", False)) == [("c", "c")]
    home = spark.createDataFrame([("a", None, "shop/x", "m:1"), ("b", "pay", "", "m:2"), ("c", "pay", "", "m:3"), ("d", "", "", "plain")], "id string, repo_slug string, module_slug string, full string").select("id", graph.repo_of(node_id="full").alias("repo"))
    assert rows(graph.across(edges, home).select("src", "dst", "src_repo", "dst_repo")) == [("a", "b", "shop", "pay")]


def test_vector_search(spark):
    df = spark.createDataFrame([("c", [0.0, 0.0, 1.0], "y"), ("a", [1.0, 0.0, 0.0], "x"), ("b", [0.0, 1.0, 0.0], "x"), ("z", [1.0], "x"), ("n", None, "x")], "id string, v array<float>, kind string")
    assert [r["id"] for r in search.top_k(df, "v", [0.9, 0.1, 0.0], 3, "id").collect()] == ["a", "b", "c"]
    assert [r["id"] for r in search.top_k(df, "v", [0.9, 0.1, 0.0], 3, "id", F.col("kind") == "y").collect()] == ["c"]
    assert not rows(search.top_k(df, "v", [0.9, 0.1, 0.0], 0, "id"))


def test_hybrid_falls_back_only_when_keywords_are_weak(spark):
    words = spark.createDataFrame([("a", 2)], "id string, score long")
    vectors = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "id string, score double")
    assert rows(search.hybrid(words, vectors, 5, "id")) == [("a", 2.0, "keyword"), ("b", 8.0, "vector")]
    assert rows(search.hybrid(words.withColumn("score", F.lit(10)), vectors, 5, "id")) == [("a", 10.0, "keyword")]


def test_packing_and_splitting(spark):
    df = spark.createDataFrame([(1, "p" * 500 + "\n" + "q" * 500 + "\nz"), (2, ""), (3, "x" * 5000), (4, None)], "id int, text string")
    got = {r["id"]: r["c"] for r in df.select("id", search.pack_paragraphs(F.col("text")).alias("c")).collect()}
    assert [len(x) for x in got[1]] == [500, 502] and got[2] == [] and len(got[3][0]) == 5000
    parts = search.split_oversized(df.where("id = 3"), "text", 400).orderBy("part").collect()
    assert "".join(r["text"] for r in parts) == "x" * 5000 and all(len(r["text"]) <= 1600 for r in parts)


def test_embedding_and_summaries_try_again(spark, tmp_path):
    flag = str(tmp_path / "seen")

    def embed(texts):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise search.RetryLater
        return np.ones((len(texts), 2), np.float32)

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string").coalesce(1)
    assert [list(r["embedding"]) for r in search.embed_table(df, "text", embed, wait_s=0.01).collect()] == [[1.0, 1.0]] * 2

    def summarize(batch):
        if len(batch) > 1:
            raise search.TooLong
        if batch[0]["id"] == 2:
            raise search.TooLong
        return ["good"]

    assert rows(search.summarize_table(df, "id", summarize)) == [(1, "good", False), (2, "id: 2", True)]
    assert all(r["fallback"] for r in search.summarize_table(df, "id").collect())


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.write("t", df)
    assert store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]) == 1
    assert rows(store.read("t")) == [(1, "a"), (2, "c"), (3, "d")]
    assert not store.write_if_changed("t", store.read("t")) and store.write_if_changed("t", df)
    assert store.append_unique("t", spark.createDataFrame([(2, "x"), (9, "y")], "id int, v string"), ["id"]) == 1
    store.delete("t", F.col("id") > 1)
    assert rows(store.read("t")) == [(1, "a")]
    assert not rows(store.read("none", "id int"))
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_a_table_that_was_never_written_is_known_to_be_empty(spark, tmp_path):
    none = Store(spark, f"file://{tmp_path}/kb").read("none", "id int NOT NULL, at timestamp, m map<string,int>, a array<struct<b:string>>")
    assert none.schema.simpleString() == "struct<id:int,at:timestamp,m:map<string,int>,a:array<struct<b:string>>>"
    assert "LocalRelation <empty>" in none._jdf.queryExecution().optimizedPlan().toString()  # so no task is run for it


def test_steps_run_side_by_side_after_those_they_need(spark):
    import threading

    both, group = threading.Barrier(2, timeout=60), lambda: spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    spark.sparkContext.setJobGroup("steps", "")
    wait = lambda: both.wait() * 0 + spark.range(3).count()  # noqa: E731  neither gets through alone
    out = together(spark, {"a": ((), wait), "b": ((), wait), "c": (("a", "b"), lambda a, b: (a + b, group()))}, 2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out == {"a": 3, "b": 3, "c": (6, "steps")}

    ran = []
    with pytest.raises(ZeroDivisionError):
        together(spark, {"bad": ((), lambda: 1 / 0), "after": (("bad",), ran.append), "other": ((), lambda: ran.append("other"))})
    assert ran == ["other"]


JAVA = {
    "a/WebConfig.java": """package c.a;
@EnableConfigurationProperties(WebProperties.class)
class WebConfig { @Bean WebMvcRegistrations regs(WebProperties p) { return null; } }""",
    "a/WebProperties.java": """package c.a;
@ConfigurationProperties(prefix = "my.web")
class WebProperties { Api adminApi = new Api("/admin-api", "**.controller.admin.**"); Api appApi = new Api("/app-api", "**.controller.app.**"); }""",
    "b/OtherProperties.java": """package c.b;
@ConfigurationProperties("other")
class OtherProperties { Api openApi = new Api("/open", "**.controller.open.**"); Api twice = new Api("/late", "**.controller.app.**"); }""",
    "c/Mvc.java": """package c.c;
class Mvc implements WebMvcConfigurer { void configurePathMatch(PathMatchConfigurer x) { x.addPathPrefix("/inner", HandlerTypePredicate.forBasePackage("c.inner")); } }""",
    "d/Auto.java": """package c.d;
class Auto { void f(PathMatchConfigurer x) { x.addPathPrefix("/auto", c -> c.getPackageName().startsWith("c.auto")); } }""",
}


def test_rules_come_from_all_detectors_in_order(spark):
    files = spark.createDataFrame(list(JAVA.items()), "path string, content string")
    pairs = spark.createDataFrame([("my.web.admin-api.prefix", "/boss"), ("x.web.more.prefix", "more"), ("x.web.more.controller", "**.more.**"), ("x.web.half.prefix", "/half"), ("y.nope.prefix", "/n"), ("y.nope.controller", "**.n.**")], "key string, value string")
    starters = spark.createDataFrame([("d", ["c.d.Auto", "c.gone.Nothing"])], "module string, autoconfigs array<string>")
    got = {r["pattern"]: (r["prefix"], r["source"], r["det_rank"], r["confidence"]) for r in rules.discover(files, pairs, starters).collect()}
    assert got == {
        "**.controller.admin.**": ("/boss", "WebProperties.field:adminApi+yml", 1, "high"), "**.controller.app.**": ("/app-api", "WebProperties.field:appApi", 1, "high"),
        "**.controller.open.**": ("/open", "OtherProperties.field:openApi", 3, "high"), "c.inner.**": ("/inner", "Mvc.addPathPrefix", 4, "high"), "c.auto.**": ("/auto", "Auto.addPathPrefix", 5, "high"), "**.more.**": ("/more", "yml-only:x.web.more", 6, "high"),
    }
    few = rules.discover(files.where("path LIKE 'c/%'"), pairs.limit(0))
    assert [(r["prefix"], r["confidence"]) for r in few.collect()] == [("/inner", "medium")] and not rows(rules.discover(files.limit(0), pairs.limit(0)))


def test_rules_merge(spark):
    auto = spark.createDataFrame([("/a", " **.x.** ", "yml"), ("/c", "**.y.**", "source")], "prefix string, pattern string, source string")
    manual = spark.createDataFrame([("/m", "**.x.**")], "prefix string, pattern string")
    assert rows(rules.merge_manual(auto, manual)) == [("/c", "**.y.**", "source", None, "high"), ("/m", "**.x.**", "manual", "yml", "high")]
    assert rows(rules.merge_manual(auto.limit(0), manual).select("source", "confidence")) == [("manual", "medium")]
    a, b = rules.rules_hash(auto).first()[0], rules.rules_hash(shuffled(spark, rows(auto), auto.schema)).first()[0]
    assert a == b
    before = spark.createDataFrame([("GET", "/orders/{id}"), ("POST", "/orders"), ("GET", "/same")], "method string, path string")
    after = spark.createDataFrame([("GET", "/admin/orders/{id}"), ("GET", "/b/orders/{id}"), ("PUT", "/x/orders"), ("GET", "/same")], "method string, path string")
    assert rows(rules.sample_changes(before, after)) == [("GET", "/orders/{id}", "/admin/orders/{id}")]


FACTS = {"goal": "g", "spec": "s", "plan": "p", "risk": "low", "approval": "approved", "total": 2, "done": 2, "verdict": "PASS", "findings": 0, "blockers": 0, "db_present": True, "scan_present": True}
FACT_TYPES = "goal string, spec string, plan string, risk string, approval string, total bigint, done bigint, verdict string, findings bigint, blockers bigint, db_present boolean, scan_present boolean"


def test_phases(spark):
    cases = [
        ("idle", "none", {"goal": None, "spec": None, "plan": None}), ("blocked", "start_init", {"scan_present": False}), ("blocked", "start_init", {"db_present": False}), ("brainstorming", "plan_from_spec", {"approval": None}),
        ("spec_pending_approval", "await_spec_approval", {"risk": "high", "approval": "pending"}), ("planning", "implement_plan", {"total": 0, "done": 0}), ("planning", "plan_from_spec", {"total": 0, "done": 0, "plan": None}), ("implementing", "implement_plan", {"done": 1}),
        ("verifying", "verify", {"verdict": "none"}), ("verifying", "finish_feature", {"verdict": "FAIL"}), ("verifying", "verify", {"findings": 2}), ("verifying", "verify", {"findings": None}), ("done", "none", {"approval": "auto_approved"}), ("idle", "auto_brainstorm", {"blockers": 1}), ("idle", "auto_brainstorm", {"spec": None, "plan": None, "approval": None, "total": 0, "done": 0}),
    ]
    data = [tuple((FACTS | change).values()) for _, _, change in cases]
    got = status.phase(spark.createDataFrame([(i, *d) for i, d in enumerate(data)], f"i int, {FACT_TYPES}")).orderBy("i").collect()
    assert [(r["phase"], r["next_action"]) for r in got] == [(a, b) for a, b, _ in cases]
    assert all(r["loop_done"] == (r["phase"] in ("done", "brainstorming")) for r in got)  # the loop's end does not ask for an approval


def test_ledgers_and_lines(spark):
    md = spark.createDataFrame([("p", "- [x] a\n- [ ] b\n  * [!] c\n+ [~] d\n- [ ]\n"), ("q", "none"), ("r", ""), ("s", None), ("t", "- [X] z")], "k string, t string")
    assert rows(status.ledger(md, "k", "t")) == [("p", 4, 1, 2, False, False), ("q", 0, 0, 0, False, True), ("r", 0, 0, 0, False, False), ("s", 0, 0, 0, False, False), ("t", 1, 1, 0, True, False)]
    assert one(spark, status.current_task(F.col("a")), a="# T\n- [x] a\n- [ ] b c \n- [ ] d") == "b c" and one(spark, status.current_task(F.col("a")), a="- [x] a") is None
    assert one(spark, status.goal(F.col("a")), a="# Head\n<!-- c -->\n\n  Ship it \nMore") == "Ship it" and len(one(spark, status.goal(F.col("a")), a="y" * 300)) == 120


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.estimate_tokens(F.col("a")), a="abcde") == 2 and one(spark, T.utf16_tokens(F.col("a")), a="😀" * 4) == 2
    assert one(spark, T.chunk_title(F.col("a"), F.col("b")), a="x\n# Hi \n", b="p/q") == "Hi" and one(spark, T.chunk_title(F.col("a"), F.col("b")), a="x", b="p/q/") == "q" and one(spark, T.chunk_title(F.col("a"), F.col("b")), a="x", b="") == "Overview"
    assert one(spark, T.join_path(F.col("a"), F.col("b")), a="/x/", b="//y/") == "/x/y"
    assert one(spark, T.keyword_score("blue bolt", F.col("a")), a="a Bolt") == 2 and one(spark, T.keyword_score("blue bolt", F.col("a")), a="BLUE BOLT") == 10
    assert one(spark, T.section(F.col("a"), F.lit("two")), a="# t\n## One\na\n## Two\nb\nc\n## Three\n") == "## Two\nb\nc"
    assert one(spark, T.css_properties(F.col("a")), a=":root{--a: 1px; --b:red; --a: 2px}") == {"--b": "red", "--a": "2px"}
    assert one(spark, T.ordered_bucket(F.col("a"), T.TOKEN_BUCKETS), a="border-radius") == "colors" and one(spark, T.ordered_bucket(F.col("a"), T.TOKEN_BUCKETS), a="zzz") == "other"
    assert one(spark, T.frontmatter(F.col("a")), a="---\nrisk: high\nname: \"x y\"\nrisk: low\n---\nbody") == {"risk": "high", "name": "x y"}
    assert one(spark, T.verdict(F.col("a")), a="**Verdict:** pass") == "PASS" and one(spark, T.verdict(F.col("a")), a="?") == "none"
    assert one(spark, T.json_text(F.col("a")), a='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, T.hex_colour(F.lit(0.2), F.lit(0.4), F.lit(1.0), F.lit(1.0))) == "#3366ff" and one(spark, T.hex_colour(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.5))) == "rgba(0, 0, 0, 0.5)"
    assert one(spark, T.slug(F.col("a")), a="--A b__C!") == "a-b-c" and one(spark, T.slug_each(F.col("a")), a="@x/A_b") == "a-b"
    assert one(spark, T.asset_part(F.col("a"), 4), a="backend/m/util/N") == "N" and one(spark, T.asset_part(F.col("a"), 4), a="nope") is None
    assert one(spark, T.referenced_types(F.col("a")), a="Map<String, List<OrderDTO>>") == ["Map", "String", "List", "OrderDTO"]
    assert one(spark, T.simple_type(F.col("a")), a="java.util.List<Foo>") == "List"


def test_markdown_is_in_order_and_escaped(spark):
    df = shuffled(spark, [("m", "b", "x|y"), ("m", "a", "1\n2")], "g string, k string, v string")
    got = markdown_table(df, ["g"], {"k": "Key", "v": "Value"}, ["k"], F.col("g")).first()["markdown"]
    assert got == "# m\n\n| Key | Value |\n|---|---|\n| a | 1 2 |\n| b | x\\|y |\n"


def test_deep_trees_flatten_whole(spark):
    from lodestone.operators.tree import flatten

    chain = [(str(i), str(i - 1) if i else None, f"n{i}") for i in range(40)] + [("c1", "c2", "x"), ("c2", "c1", "y"), ("lost", "nowhere", "z"), ("abs", "5", "/root")]
    got = dict(rows(flatten(spark.createDataFrame(chain, "id string, parent string, path string"))))
    assert len(got) == 41 and got["39"] == "/" + "/".join(f"n{i}" for i in range(40)) and got["abs"] == "/root"


def test_json_flattens_to_dotted_keys(spark):
    text = '{"a": {"b": {"c": 1}, "d": "x"}, "e": [1, 2], "f": null, "g": true}'
    got = one(spark, T.flat_json(F.col("a")), a=text)
    assert [(r["key"], r["value"]) for r in got] == [("a.b.c", "1"), ("a.d", "x"), ("e", "[1,2]"), ("f", None), ("g", "true")]


def test_scopes_are_inferred(spark):
    df = spark.createDataFrame([(["backend", "frontend"], "x", "util"), (["backend"], "x", "component"), ([], "x", "component"), ([], "x", "rpc"), ([], "packages/a/b.ts", "util"), ([], "src/x.ts", "util")], "k array<string>, p string, t string")
    assert [r[0] for r in df.select(T.asset_scope(F.col("k"), F.col("p"), F.col("t"))).collect()] == ["frontend", "backend", "frontend", "backend", "frontend", "backend"]


def test_long_texts_are_split_by_the_splitter_or_locally(spark):
    df = spark.createDataFrame([("a", "short"), ("b", "one. " * 50), ("c", "bad " * 50), ("d", "\n\n".join("para " * 10 for _ in range(6))), ("e", None)], "k string, t string")
    tries = []

    def split(text):
        if text.startswith("bad"):
            raise ValueError
        if text.startswith("one") and not tries:
            tries.append(1)
            raise search.RetryLater
        return [{"title": "T", "text": "x"}, {"title": "U", "text": "y"}, {"oops": 1}] if text.startswith("one") else []

    got = {}
    for r in search.split_semantic(df, "t", split, budget=20, wait_s=0).collect():
        got.setdefault(r["k"], []).append((r["part"], r["chunk_title"], r["chunk"]))
    assert got["a"] == [(0, "short", "short")] and got["b"] == [(0, "T", "x"), (1, "U", "y")]
    assert "".join(c for *_, c in got["c"]).replace("\n\n", "") == "bad " * 50 and len(got["d"]) > 1 and "e" not in got
