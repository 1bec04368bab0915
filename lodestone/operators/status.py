"""Rules that turn facts into risk, phase and next action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of a task list: [x] done, [ ] open, [!], [~] or [?] blocked.
TASK = r"^\s*[-*+]\s*\[([ xX!~?])\]\s+\S"
DRIFT = "task list present but no task lines recognised"


def risk(text: Column, size: Column, keywords: Sequence[str], limit: int) -> Column:
    """high if the text holds an address, medium if it is long or names a keyword, else low."""
    named = F.lit(False)
    for k in keywords:
        named = named | F.contains(F.lower(text), F.lit(k.lower()))
    return F.when(text.rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "high").when(size > limit, "medium").when(named, "medium").otherwise("low")


def ledger(md: DataFrame, key: str, text: str) -> DataFrame:
    """(key, total, done, blocked, all_done, drift) of a Markdown task list.

    drift says that a list has text but no task line, so its format is another; an empty or null text has 0 tasks.
    """
    marks = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.regexp_extract(x, TASK, 1)), lambda x: x != "")
    has = lambda signs: F.size(F.filter("_marks", lambda x: x.isin(*signs))).cast("bigint")
    counted = md.select(key, marks.alias("_marks"), (F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("_some"))
    out = counted.select(key, F.size("_marks").cast("bigint").alias("total"), has("xX").alias("done"), has("!~?").alias("blocked"), "_some")
    return out.select(key, "total", "done", "blocked", ((F.col("total") > 0) & (F.col("done") == F.col("total"))).alias("all_done"), (F.col("_some") & (F.col("total") == 0)).alias("drift"))


def first_line(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group says in the first line that it fits (W10); null if none does."""
    fitting = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x.rlike(pattern))
    return F.when(F.size(fitting) > 0, F.regexp_extract(F.element_at(fitting, 1), pattern, group))


def current_task(text: Column) -> Column:
    """The first open task of a list."""
    return F.trim(first_line(text, r"^\s*[-*+]\s*\[\s\]\s+(.+)$"))


def goal(text: Column) -> Column:
    """The first line that is no heading and no comment, at most 120 characters."""
    line = F.trim(first_line(text, r"^\s*(?!#|<!--|\s)(.*\S.*)$", 0))
    return F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 117), F.lit("..."))).otherwise(line)


def phase(facts: DataFrame) -> DataFrame:
    """facts with phase, loop_done and next_action.

    facts: goal, spec, plan, risk, approval (null, pending, approved, auto_approved), total, done, verdict, findings (null
    if there is no audit), blockers (number of them), db_present, scan_present. The order of the tests is the rule.
    """
    c = F.col
    approved = F.coalesce(c("approval").isin("approved", "auto_approved"), F.lit(False))
    pending = F.coalesce(c("risk") == "high", F.lit(False)) & ~approved
    clean = F.coalesce(c("findings") == 0, F.lit(False))
    passed = F.coalesce(c("verdict") == "PASS", F.lit(False))
    all_done = (c("total") > 0) & (c("done") == c("total"))
    missing = ~c("db_present") | ~c("scan_present")
    done = c("goal").isNotNull() & c("plan").isNotNull() & all_done & passed & clean & ~pending & (c("blockers") == 0) & ~missing
    p = (
        F.when(missing, "blocked")
        .when(c("spec").isNull() & c("plan").isNull() & c("goal").isNull(), "idle")
        .when(pending, "spec_pending_approval")
        .when(c("spec").isNotNull() & c("approval").isNull(), "brainstorming")
        .when(approved & (c("total") == 0), "planning")
        .when((c("total") > 0) & (c("done") < c("total")), "implementing")
        .when(all_done & (~passed | ~clean), "verifying")
        .when(done, "done")
        .otherwise("idle")
    )
    action = (
        F.when(c("phase") == "blocked", "start_init")
        .when(c("phase") == "done", "none")
        .when(c("phase") == "spec_pending_approval", "await_spec_approval")
        .when(c("phase") == "verifying", F.when(c("verdict") == "FAIL", "finish_feature").otherwise("verify"))
        .when(c("phase") == "implementing", "implement_plan")
        .when(c("phase") == "planning", F.when(c("plan").isNotNull(), "implement_plan").otherwise("plan_from_spec"))
        .when(c("phase") == "brainstorming", F.when(c("spec").isNotNull(), "plan_from_spec").otherwise("auto_brainstorm"))
        .otherwise(F.when(c("goal").isNotNull(), "auto_brainstorm").otherwise("none"))
    )
    return facts.withColumn("phase", p).withColumn("loop_done", done).withColumn("next_action", action)
