"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue, one rendering in which that speaker is the assistant, the others
are named users, and the loss mask covers exactly the assistant's turns. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


#: The name of the speaker whose role is null; "%" before anything else than two hex digits stands in no other name.
NOBODY = "%unknown"
#: What could end a name or forge a marker, and its escape; the escape's own sign first, so that names stay apart.
ESCAPES = {"%": "%25", "<": "%3C", "\n": "%0A", "\r": "%0D"}


def _name(role: Column) -> Column:
    """A speaker's name as rendered: the role itself in whatever script, escaped so that different roles never get one name."""
    for sign, escape in ESCAPES.items():
        role = F.replace(role, F.lit(sign), F.lit(escape))
    return F.coalesce(role, F.lit(NOBODY))


def rotate(turns: DataFrame, system_role: str = "system") -> DataFrame:
    """(conv_id, participant, rendered, mask_spans, n_turns, n_mask_chars) per dialogue and participant.

    turns has conv_id, turn, role, text; other columns are ignored, whatever their names. Turns are ordered
    by turn, then role, then text, nulls first. Rows equal in all four columns are one turn, a null text being
    an empty one. A null conv_id names no dialogue and is left out. Speakers are told apart by their role as it
    is, in any script; participant and the names in renderings are the roles with ESCAPES, NOBODY for null. Turns
    of system_role are rendered as such for everybody, are never masked in and are no participant; a dialogue of
    only system turns gives no row, as does an empty table. Texts go in whole, however long. The markers'
    opening "<|im_" inside a text is broken up, so no text can forge a turn.

    mask_spans lists "start:end" character ranges of rendered, comma separated: each of the participant's
    turns with its end marker.
    """
    t = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", _name(F.col("role")).alias("name"), F.col("role").alias("role"), F.coalesce(F.replace(F.col("text"), F.lit("<|im_"), F.lit("<| im_")), F.lit("")).alias("said")
    )
    one = F.sort_array(F.collect_set(F.struct("turn", "role", "said", "name")))
    g = t.groupBy("conv_id").agg(one.alias("turns"))
    others = F.array_distinct(F.transform(F.filter("turns", lambda x: ~x["role"].eqNullSafe(system_role)), lambda x: x["name"]))
    p = g.select("conv_id", "turns", F.explode(others).alias("participant"))
    head = lambda x: F.when(x["role"].eqNullSafe(system_role), F.lit(f"{BEGIN}system\n")).when(x["name"] == F.col("participant"), F.lit(f"{BEGIN}assistant\n")).otherwise(F.concat(F.lit(f"{BEGIN}user name="), x["name"], F.lit("\n")))
    parts = p.select(
        "conv_id",
        "participant",
        F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(x["said"], F.lit(END)).alias("body"), (x["name"] == F.col("participant")).alias("own"))).alias("parts"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("bigint").alias("chars"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            (acc["chars"] + F.when(x["own"], end - begin).otherwise(F.lit(0)).cast("bigint")).alias("chars"),
        )

    folded = parts.withColumn("mask", F.aggregate("parts", start, step))
    return folded.select(
        "conv_id",
        "participant",
        F.concat_ws("", F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("\n")))).alias("rendered"),
        F.array_join(F.col("mask")["spans"], ",").alias("mask_spans"),
        F.size("parts").cast("bigint").alias("n_turns"),
        F.col("mask")["chars"].alias("n_mask_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role,
    coalesce(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'), chr(13), '%0D'), '%unknown') AS name,
    coalesce(replace(text, '<|im_', '<| im_'), '') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, name AS participant FROM t WHERE role IS DISTINCT FROM 'system'),
r AS (
  SELECT p.conv_id, p.participant, t.turn, t.role, t.said, t.name = p.participant AS own,
    CASE WHEN t.role IS NOT DISTINCT FROM 'system' THEN '<|im_start|>system' WHEN t.name = p.participant THEN '<|im_start|>assistant'
         ELSE '<|im_start|>user name=' || t.name END || chr(10) AS head,
    t.said || '<|im_end|>' AS body
  FROM p JOIN t USING (conv_id)),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant
    ORDER BY turn NULLS FIRST, role NULLS FIRST, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM r)
SELECT conv_id, participant,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, said) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN (pos0 + length(head))::BIGINT::VARCHAR || ':' || (pos0 + length(head) + length(body))::BIGINT::VARCHAR END, ','
    ORDER BY turn NULLS FIRST, role NULLS FIRST, said), '') AS mask_spans,
  count(*)::BIGINT AS n_turns,
  coalesce(sum(CASE WHEN own THEN length(body) END), 0)::BIGINT AS n_mask_chars
FROM o GROUP BY conv_id, participant
"""
