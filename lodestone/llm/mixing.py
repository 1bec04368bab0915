"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import keep_ids

#: Production parameters of the query and the pipeline. A source that WEIGHTS doesn't name weighs 1.
WEIGHTS = {"src0": 2.0, "src1": 1.5}
BLOCK_TOKENS, SHARD_ROWS, FRACTION, SEED = 2048, 4096, 0.6, 17


def tokens(text: Column) -> Column:
    """Runs of characters other than space, tab, CR and LF; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def shard_of(doc_id: Column, n_shards: int) -> Column:
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % n_shards, F.lit(0)).cast("bigint")


def select_blocks(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """(doc_id, source, shard, block, places, quota, n_tokens) for each document of a chosen block.

    docs has doc_id, text and source; other columns are ignored. Documents fall by a hash of doc_id into as many
    shards as there are shard_rows rows. Inside a shard and source they are laid end to end by doc_id (nulls
    first, then by token count) over places of block_tokens tokens each, the last one being whatever is left. A
    block is the documents whose first token lies in the same place; documents stay whole, so a block whose last
    document is long takes all the places up to the next block's, and every place stands for as many tokens.

    Each shard hands out ceil(fraction x its places), one by one, to the source with the highest quotient
    weight / (2 x places so far + 1) that has places left (ties: by name); quota is the number that source got.
    A source's blocks are lined up by a seeded hash, and those are chosen whose middle place lies within its
    quota: a long block at the end is taken or left as it fits better. So a shard's source differs from its quota
    by half of one block at most, up or down.

    A null source is the source "". A null doc_id belongs to shard 0. Null and blank texts have 0 tokens and
    go with the block where they stand; a source without any token has one place. Repeated rows are laid side
    by side like any others, so each counts. A source with weight 0 or less gets nothing. An empty table gives
    no rows.

    Only narrow rows are shuffled, and every window is over the rows of one shard, so tasks are as many and as
    small at any size; the rows are counted first, from the files' footers where docs is a scan.
    """
    n_shards = max(1, -(-docs.select().count() // shard_rows))
    t = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens(F.col("text")).alias("n_tokens"))
    t = t.withColumn("shard", shard_of(F.col("doc_id"), n_shards))
    own = Window.partitionBy("shard", "source")
    laid = t.withColumn("upto", F.sum("n_tokens").over(own.orderBy(F.asc_nulls_first("doc_id"), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("block", F.floor((F.col("upto") - F.col("n_tokens")) / F.lit(block_tokens)).cast("bigint"))
    blocks = laid.groupBy("shard", "source", "block").agg(F.max("upto").alias("upto"))
    end = F.coalesce(F.lead("block").over(own.orderBy("block")), F.ceil(F.col("upto") / F.lit(block_tokens)))
    blocks = blocks.withColumn("places", F.greatest(end - F.col("block"), F.lit(1)).cast("bigint"))
    salt = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("shard").cast("string"), "source", F.col("block").cast("string")).cast("binary"))
    weight = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    lined = blocks.withColumn("salt", salt).withColumn("past", F.sum("places").over(own.orderBy("salt", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("places"))
    # a row for every place, numbered within its source
    place = lined.select("shard", "source", "places", weight.alias("weight"), F.explode(F.sequence("past", F.col("past") + F.col("places") - 1)).alias("k"))
    shard = Window.partitionBy("shard")
    ranked = (
        place.withColumn("quotient", F.col("weight") / (2 * F.col("k") + 1))
        .withColumn("give", F.ceil(F.count("*").over(shard) * F.lit(float(fraction))))
        .withColumn("rank", F.row_number().over(shard.orderBy(F.desc("quotient"), "source", "k")))
        .where("rank <= give AND quotient > 0")
    )
    quota = ranked.groupBy("shard", "source").agg(F.count("*").alias("quota"))
    chosen = lined.join(quota, ["shard", "source"]).where("2 * past + places <= 2 * quota").select("shard", "source", "block", "places", "quota")
    return laid.join(chosen, ["shard", "source", "block"]).select("doc_id", "source", "shard", "block", "places", "quota", "n_tokens")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """docs' rows in chosen blocks, with docs' columns. Rows that share a doc_id are taken together if any is chosen."""
    return keep_ids(docs, select_blocks(docs, **parameters).select("doc_id"))


def oracle(table: str = "documents", columns: str = "doc_id, source, shard, block, places, quota, n_tokens") -> str:
    weights = " ".join(f"WHEN source = '{k}' THEN {v!r}::DOUBLE" for k, v in reversed(WEIGHTS.items()))
    return rf"""
WITH size AS (SELECT greatest(1, (count(*) + {SHARD_ROWS - 1}) // {SHARD_ROWS}) AS shards FROM {table}),
t AS (
  SELECT doc_id, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS n_tokens,
    coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % shards, 0)::BIGINT AS shard
  FROM {table}, size),
laid AS (
  SELECT *, ((upto - n_tokens) // {BLOCK_TOKENS})::BIGINT AS block FROM (
    SELECT *, sum(n_tokens) OVER (PARTITION BY shard, source ORDER BY doc_id NULLS FIRST, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t)),
blocks AS (SELECT shard, source, block, max(upto) AS upto FROM laid GROUP BY ALL),
sized AS (
  SELECT *, greatest(coalesce(lead(block) OVER (PARTITION BY shard, source ORDER BY block), ceil(upto / {BLOCK_TOKENS})) - block, 1)::BIGINT AS places FROM blocks),
lined AS (
  SELECT *, (sum(places) OVER (PARTITION BY shard, source ORDER BY md5('{SEED}:' || shard || ':' || source || ':' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - places)::BIGINT AS past FROM sized),
q AS (
  SELECT shard, source, k, (CASE {weights} ELSE 1.0::DOUBLE END) / (2 * k + 1) AS quotient,
    ceil(count(*) OVER (PARTITION BY shard) * {FRACTION}::DOUBLE) AS give
  FROM (SELECT shard, source, unnest(range(past, past + places)) AS k FROM lined)),
r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY quotient DESC, source, k) AS rank FROM q),
quota AS (SELECT shard, source, count(*) AS quota FROM r WHERE rank <= give AND quotient > 0 GROUP BY ALL),
chosen AS (SELECT shard, source, block, places, quota FROM lined JOIN quota USING (shard, source) WHERE 2 * past + places <= 2 * quota)
SELECT {columns} FROM laid JOIN chosen USING (shard, source, block)"""
