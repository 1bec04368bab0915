"""Joins, ordered picks, merges and diffs as DataFrame functions. Order is always an explicit column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def first_wins(df: DataFrame, keys: Names, order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first by order (W1). order should be unique inside a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, keys: Names, order: Names, displaced: str | None = None) -> DataFrame:
    """One row per key, the last by order (W2); with displaced, overrides holds that column of the row before it."""
    up = Window.partitionBy(*keys).orderBy(*order)
    if displaced:
        df = df.withColumn("overrides", F.lag(displaced).over(up))
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def prefer(first: DataFrame, second: DataFrame, keys: Names) -> DataFrame:
    """All of first, and of second what first has no key for (J1); repeated rows inside a source stay."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_ranked(fields: DataFrame, keys: Names, field: str, rank: str, order: Names) -> DataFrame:
    """Fields of entities from ranked sources, united by lower-case name, the best source winning."""
    return first_wins(fields.withColumn("_field", F.lower(field)), [*keys, "_field"], [F.col(rank), *map(F.col, order)]).drop("_field")


def lookup(df: DataFrame, table: DataFrame, keys: Names, defaults: dict[str, object] | None = None) -> DataFrame:
    """Left outer lookup with defaults for what is missing."""
    out = df.join(table, list(keys), "left")
    return out.fillna(defaults) if defaults else out


def ancestors(path: Column) -> Column:
    """All prefixes of a path that end at a segment, shortest first: /a/b -> /a, /a/b (O-R2)."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def prefix_join(df: DataFrame, path: str, units: DataFrame, unit: str) -> DataFrame:
    """Segment-aware containment as an equi-join on exploded prefixes (J5): a row per unit that holds the path."""
    wide = df.withColumn("_prefix", F.explode(ancestors(F.col(path))))
    return wide.join(units, wide["_prefix"] == units[unit]).drop("_prefix")


def owner(df: DataFrame, path: str, units: DataFrame, unit: str, keys: Names) -> DataFrame:
    """The longest unit that holds each path (ownership)."""
    return first_wins(prefix_join(df, path, units, unit), keys, [F.desc(F.length(unit)), F.col(unit)])


def ant_regex(pattern: str) -> str:
    """A package pattern as a regular expression (F14): ** is any run of segments with its dots, * one segment.

    Between dots ** needs a segment on either side, as in the rule "**.core.**"; at the end "**" takes all.
    """
    if pattern == "**":
        return "^.*$"
    parts = [".*" if p == "**" else re.escape(p).replace(r"\*", "[^.]*") for p in pattern.split(".")]
    return "^" + r"\.".join(parts) + "$"


def ant_rules(df: DataFrame, name: str, rules: Sequence[tuple[str, str]], default: str = "") -> DataFrame:
    """prefix of the first rule (pattern, prefix) whose pattern fits the name (J6, first match wins).

    Rules are compiled on the driver into one CASE, so there is no join and no nested loop.
    """
    out = None
    for pattern, prefix in rules:
        hit = F.col(name).rlike(ant_regex(pattern))
        out = F.when(hit, prefix) if out is None else out.when(hit, prefix)
    return df.withColumn("prefix", F.lit(default) if out is None else out.otherwise(default))


def tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores: \\w+ without the dialects' differences."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), 0))


def term_join(df: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Whole-word matches of one-word terms as an equi-join on exploded tokens (J7, J9, O-R1)."""
    wide = df.withColumn("_token", F.explode(tokens(F.col(text))))
    return wide.join(terms, wide["_token"] == terms[term]).drop("_token")


def phrase_join(df: DataFrame, text: str, terms: Sequence[str]) -> DataFrame:
    """Whole-word matches of any terms, several words long too (P7): one expression per term, then one explode."""
    hit = lambda t: F.col(text).rlike(rf"(?<![A-Za-z0-9_])\Q{t}\E(?![A-Za-z0-9_])")
    return df.withColumn("term", F.explode(F.array_compact(F.array(*(F.when(hit(t), t) for t in terms)))))


def candidates(df: DataFrame, options: Column, table: DataFrame, key: str, keys: Names) -> DataFrame:
    """The first of options that exists in table."""
    wide = df.select("*", F.posexplode(options).alias("_at", "_option"))
    return first_wins(wide.join(table, wide["_option"] == table[key]), keys, [F.col("_at")]).drop("_at", "_option")


def as_of(left: DataFrame, right: DataFrame, keys: Names, at: str, value: str, left_cols: Names) -> DataFrame:
    """left with the latest value of right at or before it (W3): one union, one window, no self join."""
    cols = [*keys, at]
    rows = left.select(*cols, *left_cols, F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("_side")).unionByName(
        right.select(*cols, *(F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in left_cols), value, F.lit(0).alias("_side"))
    )
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def enclosing(df: DataFrame, keys: Names, at: str, indent: str, name: str, is_scope: Column) -> DataFrame:
    """df with scope, the name of the latest scope row above it that is indented less (W5); null at the top.

    An equi-join on keys with the test of both orders behind it, then the latest by at: rows of one file, not all pairs.
    """
    scopes = df.where(is_scope).select(*keys, F.col(at).alias("_at"), F.col(indent).alias("_indent"), F.col(name).alias("_name"))
    above = df.select(*keys, at, indent).join(scopes, list(keys)).where((F.col("_at") < F.col(at)) & (F.col("_indent") < F.col(indent)))
    best = above.groupBy(*keys, at).agg(F.max_by("_name", "_at").alias("scope"))
    return df.join(best, [*keys, at], "left")


def islands(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """df with island, a number that is the same inside a run of equal values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mark: str, epsilon: float | None = None) -> DataFrame:
    """(key, status): added, modified, deleted or unchanged between two snapshots (U3; with epsilon U4)."""
    o, n = old.select(F.col(key), F.col(mark).alias("_old"), F.lit(True).alias("_was")), new.select(F.col(key), F.col(mark).alias("_new"), F.lit(True).alias("_is"))
    same = F.col("_old").eqNullSafe(F.col("_new")) if epsilon is None else F.abs(F.col("_old") - F.col("_new")) <= epsilon
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: Names, order: Names = ()) -> DataFrame:
    """old with new's rows in place of those with their key (M1); of repeated keys in new the last by order counts."""
    if order:
        new = last_wins(new, keys, order)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def delete_ids(df: DataFrame, ids: DataFrame, keys: Names) -> DataFrame:
    """df without the rows with a key in ids (M2)."""
    return df.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def under(path: Column, prefix: str, separator: str = "/") -> Column:
    """Segment-aware prefix test (P4): the path itself or something below it."""
    return (path == prefix) | F.startswith(path, F.lit(prefix.rstrip(separator) + separator))


def delete_prefix(df: DataFrame, path: str, prefix: str, separator: str = "/") -> DataFrame:
    """df without what lies under prefix (M2, P5): siblings with a longer name stay; null paths stay."""
    return df.where(~F.coalesce(under(F.col(path), prefix, separator), F.lit(False)))


def ignored(path: Column, segments: Names) -> Column:
    """Whether one of the segments is a whole segment of the path."""
    hit = F.lit(False)
    for s in segments:
        hit = hit | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(f"/{s}/"))
    return hit


def allowed(df: DataFrame, column: str, values: Names) -> DataFrame:
    """Rows whose column is listed; an empty list keeps all."""
    return df.where(F.col(column).isin(list(values))) if values else df


def new_units(current: DataFrame, previous: DataFrame, keys: Names) -> DataFrame:
    """Distinct keys of current that previous lacks."""
    return current.select(*keys).subtract(previous.select(*keys))


def best_matches(df: DataFrame, keys: Names, score: str, name: str) -> DataFrame:
    """Per key the best-scored row (ties: by name) and how many share its score."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_best", F.max(score).over(w)).where(f"{score} = _best")
    return first_wins(ranked.withColumn("ties", F.count("*").over(w)), keys, [F.col(name)]).drop("_best")


def batches(df: DataFrame, order: str, size: int, span: int = 1 << 16) -> DataFrame:
    """df with batch, the number of its group of size rows by an integer column.

    A global row number would need one task. Here rows are numbered inside ranges of span values, and the sums of
    the ranges before, a table with one row per range, shift the numbers.
    """
    bucket = F.floor(F.col(order) / span)
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = df.withColumn("_bucket", bucket).withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy(order)))
    return numbered.join(before, "_bucket").withColumn("batch", F.floor((F.col("_before") + F.col("_row") - 1) / size)).drop("_bucket", "_before", "_row")
