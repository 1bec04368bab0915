"""Incremental upserts and windows by Structured Streaming."""

from pyspark.sql import functions as F

from lodestone.sources.store import Store
from lodestone.streaming.incremental import follow, windowed
from tests.helpers import rows


def test_only_new_files_are_merged(spark, tmp_path):
    store, folder, mark = Store(spark, f"file://{tmp_path}/kb"), f"file://{tmp_path}/in", f"file://{tmp_path}/mark"
    put = lambda data: spark.createDataFrame(data, "id int, v string").coalesce(1).write.mode("append").parquet(folder)
    put([(1, "a"), (2, "b")])
    follow(spark, folder, "id int, v string", store, "t", ["id"], mark)
    put([(2, "c"), (3, "d")])
    follow(spark, folder, "id int, v string", store, "t", ["id"], mark)
    assert rows(store.read("t")) == [(1, "a"), (2, "c"), (3, "d")]
    store.delete("t", F.col("id") == 1)
    follow(spark, folder, "id int, v string", store, "t", ["id"], mark)
    assert rows(store.read("t")) == [(2, "c"), (3, "d")]


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert [(r["k"], r["n"]) for r in windowed(events, "t", ["k"]).orderBy("k").collect()] == [("a", 2), ("b", 1)]
