"""Path rules of Java controllers: discovery in order of precedence, manual rules over found ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import class_name, java_package
from lodestone.operators.relational import first_wins

RULE = "prefix string, pattern string, source string, confidence string, det_rank int, file string, pos int"
#: A field with a default rule: private Api adminApi = new Api("/admin-api", "**.controller.admin.**").
FIELD = r"(\w+)\s*=\s*new\s+\w*Api\w*\s*\(\s*\"([^\"]*)\"\s*,\s*\"([^\"]*)\"\s*\)"
#: addPathPrefix("/x", HandlerTypePredicate.forBasePackage("a.b")), or a lambda that names a package.
CALL = r"(?:addPathPrefix|addPathPrefixes|pathPrefixes\.put)\s*\(\s*\"(/[^\"]*)\"\s*,[^;]*?\"([\w.*]+)\""
PROPERTIES = r"@ConfigurationProperties\s*\(\s*(?:prefix\s*=\s*|value\s*=\s*)?\"([^\"]+)\""


def kebab(name: Column) -> Column:
    """adminApi -> admin-api, as configuration keys have it (R2)."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"([A-Z])", "-$1")), "^-", "")


def from_properties(java: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file, class, prefix, pattern, source, pos): the fields' rules of property classes, with what YAML says in their place (R1 A and B, R2).

    java: path, content of Java files; pairs: key, value of application YAML. The keys are
    <prefix of the class>.<field in kebab case or as it is>.prefix and .controller.
    """
    found = java.where(F.col("content").rlike(PROPERTIES) & F.col("content").rlike(r"new\s+\w*Api\w*\s*\("))
    fields = found.select(F.col("path").alias("file"), class_name(F.col("content")).alias("class"), F.regexp_extract("content", PROPERTIES, 1).alias("_at"), F.posexplode(F.regexp_extract_all("content", F.lit(FIELD), 0)).alias("pos", "_f"))
    part = lambda i: F.regexp_extract("_f", FIELD, i)
    own = fields.select("file", "class", "pos", part(1).alias("_field"), part(2).alias("_prefix"), part(3).alias("_pattern"), F.col("_at"))

    def said(df: DataFrame, what: str, name: Column, as_: str) -> DataFrame:
        keyed = df.withColumn("_key", F.concat_ws(".", "_at", name, F.lit(what)))
        return keyed.join(pairs.select(F.col("key").alias("_key"), F.col("value").alias(as_)), "_key", "left").drop("_key")

    for what, column in (("prefix", "_prefix"), ("controller", "_pattern")):
        own = said(said(own, what, kebab(F.col("_field")), "_kebab"), what, F.col("_field"), "_plain")
        own = own.withColumn("_yml", F.col("_kebab").isNotNull() | F.col("_plain").isNotNull() | (F.col("_yml") if what == "controller" else F.lit(False)))
        own = own.withColumn(column, F.coalesce("_kebab", "_plain", column)).drop("_kebab", "_plain")
    return own.select("file", "class", F.col("_prefix").alias("prefix"), F.col("_pattern").alias("pattern"), F.concat("class", F.lit(".field:"), "_field", F.when(F.col("_yml"), "+yml").otherwise("")).alias("source"), "pos")


def from_calls(java: DataFrame) -> DataFrame:
    """(file, class, prefix, pattern, source, pos) of addPathPrefix calls and their like (R1 A inline and C); a base package means all below it."""
    found = java.where(F.col("content").rlike(CALL)).select(F.col("path").alias("file"), class_name(F.col("content")).alias("class"), F.posexplode(F.regexp_extract_all("content", F.lit(CALL), 0)).alias("pos", "_c"))
    pattern = F.regexp_extract("_c", CALL, 2)
    return found.select("file", "class", F.regexp_extract("_c", CALL, 1).alias("prefix"), F.when(F.contains(pattern, F.lit("*")), pattern).otherwise(F.concat(pattern, F.lit(".**"))).alias("pattern"), F.concat("class", F.lit(".addPathPrefix")).alias("source"), "pos")


def from_yml(pairs: DataFrame) -> DataFrame:
    """(prefix, pattern, source) of <base>.web.<name>.prefix with <base>.web.<name>.controller beside it (R1 E)."""
    key = r"^((?:.*\.)?web\.[^.]+)\.(prefix|controller)$"
    parts = pairs.where(F.col("key").rlike(key)).select(F.regexp_extract("key", key, 1).alias("base"), F.regexp_extract("key", key, 2).alias("part"), "value")
    both = parts.groupBy("base").pivot("part", ["prefix", "controller"]).agg(F.max("value")).where("prefix IS NOT NULL AND controller IS NOT NULL")
    return both.select(F.when(F.startswith("prefix", F.lit("/")), F.col("prefix")).otherwise(F.concat(F.lit("/"), "prefix")).alias("prefix"), F.col("controller").alias("pattern"), F.concat(F.lit("yml-only:"), "base").alias("source"))


def discover(files: DataFrame, pairs: DataFrame, starters: DataFrame | None = None) -> DataFrame:
    """(prefix, pattern, source, confidence): what all detectors find, the first per trimmed pattern.

    In order: A, property classes that a WebMvcRegistrations class names, or its own calls if it names none; B, other
    property classes; C, calls in WebMvcConfigurer classes; D, the classes that starters' files name (by full name);
    E, YAML alone. Property classes are sure: with a rule of theirs the whole is "high", with rules of others alone
    "medium"; an empty result has no confidence. starters: module, autoconfigs.
    """
    java = files.where(F.endswith("path", F.lit(".java")) & F.col("content").isNotNull()).select("path", "content")
    properties, calls = from_properties(java, pairs), from_calls(java)
    registering = java.where(F.col("content").rlike(r"\bWebMvcRegistrations\b"))
    # the property class is the one enabled, else the one that is a parameter, else WebProperties by its mere mention
    pick = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    named = registering.select(F.coalesce(pick(r"@EnableConfigurationProperties\s*\(\s*(\w+)\.class"), pick(r"WebMvcRegistrations\s+\w+\s*\(\s*(\w+)\s+\w+\s*\)"), F.when(F.contains("content", F.lit("WebProperties")), "WebProperties")).alias("class"))
    kinds = lambda df, rank, sure: df.select("prefix", "pattern", "source", F.lit(rank).alias("det_rank"), F.lit(sure).alias("_sure"), "file", "pos")
    chained = properties.join(named.where("class IS NOT NULL").distinct(), "class", "left_semi")
    inline = calls.join(registering.select(F.col("path").alias("file")), "file", "left_semi")
    configurer = java.where(F.col("content").rlike(r"\bWebMvcConfigurer\b")).select(F.col("path").alias("file"))
    rules = kinds(chained, 1, True).unionByName(kinds(inline, 2, False)).unionByName(kinds(properties, 3, True)).unionByName(kinds(calls.join(configurer, "file", "left_semi"), 4, False))
    if starters is not None:
        wanted = starters.select(F.explode("autoconfigs").alias("_name")).distinct()
        full = java.select(F.col("path").alias("file"), F.concat_ws(".", java_package(F.col("content")), class_name(F.col("content"))).alias("_name")).join(wanted, "_name", "left_semi").select("file")
        rules = rules.unionByName(kinds(calls.join(full, "file", "left_semi"), 5, False))
    yml = from_yml(pairs).select("prefix", "pattern", "source", F.lit(6).alias("det_rank"), F.lit(False).alias("_sure"), F.lit("").alias("file"), F.lit(0).alias("pos"))
    kept = first_wins(rules.unionByName(yml).withColumn("pattern", F.trim("pattern")), ["pattern"], ["det_rank", "file", "pos", "source", "prefix"])
    sure = F.max("_sure").over(Window.partitionBy())  # one row per pattern: a handful
    return kept.select("prefix", "pattern", "source", F.when(sure, "high").otherwise("medium").alias("confidence"), "det_rank")


def merge_manual(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """(prefix, pattern, source, overrides, confidence): manual rules win by pattern and say what they displaced."""
    a = auto.select(F.trim("pattern").alias("pattern"), F.col("prefix").alias("_prefix"), F.col("source").alias("_source"))
    m = manual.select(F.trim("pattern").alias("pattern"), F.col("prefix").alias("_manual"), F.lit(True).alias("_said"))
    both = a.join(m, "pattern", "full_outer")
    merged = both.select(F.coalesce("_manual", "_prefix").alias("prefix"), "pattern", F.when(F.col("_said"), "manual").otherwise(F.col("_source")).alias("source"), F.when(F.col("_said"), F.col("_source")).alias("overrides"))
    found = F.max((F.col("source") != "manual") | F.col("overrides").isNotNull()).over(Window.partitionBy())
    return merged.withColumn("confidence", F.when(found, "high").otherwise("medium"))


def rules_hash(rules: DataFrame) -> DataFrame:
    """One row: a hash that changes when a rule does."""
    each = F.concat_ws("|", "pattern", "prefix")
    return rules.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), ","), 256).alias("hash"))


def sample_changes(before: DataFrame, after: DataFrame, n: int = 5) -> DataFrame:
    """(method, before, after): endpoints whose new path ends with the old one, the first by path, n at most.

    An equi-join on the paths' suffixes by segment stands for the test of all pairs.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("after", "/"))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(F.split("after", "/"), i, F.size(F.split("after", "/"))), "/")))
    new = after.select("method", F.col("path").alias("after")).distinct().withColumn("before", F.explode(F.array_distinct(F.transform(ends, lambda x: F.regexp_replace(x, "^/+", "/")))))
    pairs = new.join(before.select("method", F.col("path").alias("before")).distinct(), ["method", "before"]).where("before <> after")
    return first_wins(pairs, ["method", "before"], ["after"]).select("method", "before", "after").orderBy("before", "method").limit(n)
