"""Trees as (id, parent, ...) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import cut


def flatten(nodes: DataFrame) -> DataFrame:
    """(id, path) with the paths of all ancestors in front, joined by slashes (G8, S18), however deep the tree is.

    nodes: id, parent (null at a root), path. Goes down one level at a time until a level is empty: each level is
    one equi-join with the level above it alone, which is checkpointed, so the work is the sum of the levels. A path
    that begins with / starts anew, as routers have it. Rows of a cycle, and those without a root, don't appear.
    """
    clean = F.regexp_replace(F.col("path"), "^/+|/+$", "")
    at = cut(nodes.where("parent IS NULL").select("id", F.concat(F.lit("/"), clean).alias("path")))
    out = at
    below = nodes.where("parent IS NOT NULL").select("id", "parent", F.startswith("path", F.lit("/")).alias("_root"), clean.alias("_own"))
    while not at.isEmpty():
        up = at.select(F.col("id").alias("parent"), F.col("path").alias("_up"))
        joined = F.when(F.col("_root"), F.concat(F.lit("/"), F.col("_own"))).otherwise(F.regexp_replace(F.concat_ws("/", "_up", F.nullif(F.col("_own"), F.lit(""))), "/+", "/"))
        at = cut(below.join(up, "parent").select("id", joined.alias("path")))
        out = out.unionByName(at)
    return out
