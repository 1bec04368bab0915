"""Drift audit: what changed between snapshots, sorted into what the index must do about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.relational import allowed, ignored


def classify(diff: DataFrame, index: DataFrame, key: str, ignore: Sequence[str] = (), only: Sequence[str] = ()) -> DataFrame:
    """(key, bucket) for each change (M5): an indexed one is modified or deleted, one that isn't is unregistered.

    diff: key, status as snapshot_diff gives it. Deleted things that were never indexed are no finding. The
    bucket "new" exists in the audit's vocabulary but nothing is ever sorted into it.
    """
    known = index.select(key).distinct().withColumn("_known", F.lit(True))
    changed = allowed(diff.where("status <> 'unchanged'"), key, only)
    if ignore:
        changed = changed.where(~ignored(F.col(key), ignore))
    bucket = F.when(F.col("status") == "deleted", F.when(F.col("_known"), "deleted")).when(F.col("_known"), "modified").otherwise("unregistered")
    return changed.join(known, key, "left").select(key, bucket.alias("bucket")).where("bucket IS NOT NULL")


def affected_units(changed: DataFrame, path: str, units: DataFrame, unit: str) -> DataFrame:
    """The distinct units that hold a changed path."""
    from lodestone.operators.relational import prefix_join

    return prefix_join(changed, path, units, unit).select(unit).distinct()


def carry_forward(current: DataFrame, previous: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """The next anchor's counts: this scan's, else the last one's, else 0 (M9)."""
    p = previous.select(*keys, F.col(count).alias("_before"))
    return current.select(*keys, F.col(count).alias("_now")).join(p, list(keys), "full_outer").select(*keys, F.coalesce("_now", "_before", F.lit(0)).alias(count))
