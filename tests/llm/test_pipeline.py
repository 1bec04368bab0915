"""The pipeline against its stages' brute force, run by hand."""

import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestone.llm import mixing, quality, records, simhash
from tests.helpers import rows
from tests.llm.test_operators import DOCS, ODD, brute_groups, brute_leaks, plain_signature


def test_pipeline_matches_brute_force(spark, small, duck):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pdf = docs.toPandas().sort_values("doc_id").reset_index(drop=True)
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    p = quality.probabilities(pa.array(pdf["text"].tolist()), model | {"pairs": quality._pairs(model["tables"])})
    pdf = pdf[p >= quality.REJECT]
    signed = [plain_signature(t) for t in pdf["text"]]
    sigs = np.array([((x or 0) & (1 << 64) - 1, (x or 0) >> 64) for x in signed], np.uint64)
    some = np.array([x is not None for x in signed])
    pdf = pdf[~pdf["doc_id"].isin(brute_groups(pdf["doc_id"].to_numpy(), sigs, some, simhash.THRESHOLD))]
    cut = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    leaked = {d for d, _ in brute_leaks(list(zip(pdf["doc_id"], pdf["text"])), items)}
    assert leaked >= {d for d, t in zip(pdf["doc_id"], pdf["text"]) if any(cut(i) in cut(t) for _, i in items)}
    pdf = pdf[~pdf["doc_id"].isin(leaked)]
    duck.register("left_over", pdf)
    want = sorted(r[0] for r in duck.execute(mixing.oracle("left_over", "doc_id")).fetchall())
    got = corpus_pipeline.run(spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == want and want
    assert all(records.read_record(bytes(r["record"]))[-1] == records.END_OF_TEXT for r in got)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.unionByName(odd), small).columns == docs.columns
        assert not rows(stage(spark, docs.limit(0), small))


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_records"]
    assert np.array([callable(f) for _, f in corpus_pipeline.STAGES]).all()


def test_odd_rows_survive_the_filters(spark, small):
    """Nulls, empties, repeats and long texts: only the copy goes, and everything gets a record in the end."""
    odd = spark.createDataFrame([*ODD, (9, "some other words", "en", "s", 1), (8, "some other words", "en", "s", 1)], DOCS)
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, odd, small).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [d for d, *_ in ODD] + [8]))
    assert corpus_pipeline.decontamination_stage(spark, odd, small).count() == len(ODD) + 2
    assert corpus_pipeline.records_stage(spark, odd, small).count() == len(ODD) + 2
