"""Structured Streaming over growing folders: new rows go into the store without a full scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.store import Store


def follow(spark: SparkSession, folder: str, schema: str, store: Store, table: str, keys: Sequence[str], checkpoint: str, order: Sequence[str] = (), change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Upserts what has come into a folder of Parquet since the last call, then stops (M1, M7 without a git anchor).

    Progress is kept in checkpoint, so a file counts once however often this is called. A batch that is run again
    after a failure upserts the same rows: the result is the same.
    """

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(table, change(batch), keys, order)

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, at: str, by: Sequence[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by time window, final once events are later than late; for batches and streams alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
