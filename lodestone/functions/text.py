"""Scalar functions over text, paths, names and JSON as Column expressions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """ceil(characters / 4) (F1)."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def utf16_tokens(text: Column) -> Column:
    """The same over UTF-16 units, of which characters outside the basic plane have two."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 8).cast("bigint")


def fits(text: Column, budget: int) -> Column:
    """Whether the trimmed text needs no split (F2)."""
    return estimate_tokens(F.trim(text)) <= budget


def chunk_title(md: Column, path: Column) -> Column:
    """The first "# " heading, else the path's last segment, else "Overview" (F3)."""
    head = F.nullif(F.trim(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(head, F.when(F.size(parts) > 0, F.element_at(parts, -1)), F.lit("Overview"))


def slug(text: Column) -> Column:
    """Lower case, other signs as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_each(text: Column) -> Column:
    """A package name's variant: each other sign is a dash of its own; a leading @scope goes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "^@[^/]+/", ""), "[^a-z0-9-]", "-")


def join_path(*parts: Column) -> Column:
    """Segments as one URL path: single slashes, one in front, none behind."""
    joined = F.regexp_replace(F.concat_ws("/", F.lit(""), *parts), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def asset_id(*parts: Column) -> Column:
    """scope/module/kind/name."""
    return F.concat_ws("/", *parts)


def asset_part(asset: Column, n: int) -> Column:
    """The n-th part, from 1, of an asset id; null if it isn't one."""
    return F.nullif(F.regexp_extract(asset, r"^(backend|frontend)/([^/]+)/([a-z-]+)/(.+)$", n), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def list_hash(values: Column) -> Column:
    """A hash of a list that doesn't depend on its order."""
    return F.sha2(F.array_join(F.sort_array(values), ","), 256)


def keyword_score(query: str, text: Column) -> Column:
    """10 if the query is a substring, else 2 for each of its words that is (F11); without regard to case."""
    low, q = F.lower(text), query.lower().strip()
    parts = [p for p in q.split() if p]
    each = F.lit(0)
    for p in parts:
        each = each + F.when(F.contains(low, F.lit(p)), 2).otherwise(0)
    return F.coalesce(F.when(F.contains(low, F.lit(q)), 10).otherwise(each), F.lit(0)).cast("bigint") if q else F.lit(0).cast("bigint")


def strip_prefix(name: Column) -> Column:
    """A component's name without the usual library prefixes."""
    return F.regexp_replace(name, "^(Base|App|Ui|UI|The|V|El|A|N)(?=[A-Z])", "")


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def section(md: Column, heading: Column) -> Column:
    """The lines from the H2 with the heading up to the next H2 (F13); null if there is none."""
    body = F.filter(F.split(F.concat(F.lit("\n"), md), r"\n(?=## )"), lambda s: F.lower(F.trim(F.regexp_extract(s, r"^## ([^\n]*)", 1))) == F.lower(heading))
    return F.when(F.size(body) > 0, F.element_at(body, 1))


def java_package(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))


def class_name(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"\b(?:class|interface|enum|record)\s+(\w+)", 1), F.lit(""))


def backend_layer(path: Column) -> Column:
    """The layer a backend file's path speaks of; the first rule counts."""
    return (
        F.when(path.rlike("(?i)controller"), "controller")
        .when(path.rlike("(?i)service"), "service")
        .when(path.rlike("(?i)(mapper|repository|dao)"), "repository")
    )


def ordered_bucket(name: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The bucket of the first regular expression that fits."""
    out = None
    for pattern, bucket in rules:
        hit = name.rlike(pattern)
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return F.lit(default) if out is None else out.otherwise(default)


#: Token names and their buckets; the order is part of the meaning, as border-radius is a colour by it.
TOKEN_BUCKETS = (
    ("(?i)^(--)?(color|bg|background|text|border|fill|stroke|primary|accent)", "colors"),
    ("(?i)(font|line-height|letter)", "typography"),
    ("(?i)(space|spacing|gap|padding|margin)", "spacing"),
    ("(?i)(radius|rounded)", "radii"),
    ("(?i)(shadow|elevation)", "shadows"),
    ("(?i)(duration|ease|transition|motion)", "motion"),
)


def css_properties(css: Column) -> Column:
    """Custom properties of a style sheet as a map; a later one wins."""
    found = F.regexp_extract_all(css, F.lit(r"(--[\w-]+)\s*:\s*([^;}]+)"), 0)
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(--[\w-]+)", 1).alias("key"), F.trim(F.regexp_extract(x, r":\s*([^;}]+)$", 1)).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def hex_colour(r: Column, g: Column, b: Column, a: Column) -> Column:
    """0..1 channels as #rrggbb, or rgba(...) if not opaque."""
    byte = lambda x: F.round(x * 255).cast("int")
    two = lambda x: F.lower(F.lpad(F.hex(byte(x)), 2, "0"))
    rgba = F.format_string("rgba(%d, %d, %d, %s)", byte(r), byte(g), byte(b), F.regexp_replace(F.round(a, 2).cast("string"), r"\.0$", ""))
    return F.when(F.coalesce(a, F.lit(1.0)) >= 1, F.concat(F.lit("#"), two(r), two(g), two(b))).otherwise(rgba)


def html_title(html: Column, fallback: Column) -> Column:
    """title, else the first h1, else the fallback."""
    pick = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))
    return F.coalesce(pick("title"), pick("h1"), fallback)


def data_components(html: Column) -> Column:
    """Distinct values of data-component in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"data-component=[\"']([^\"']+)[\"']"), 1))


def frontmatter(md: Column) -> Column:
    """key: value lines between the leading --- lines as a map; the first of a key counts."""
    head = F.regexp_extract(md, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), "^\\s*[\"']|[\"']\\s*$", "")).alias("value")))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, 1, i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(first)


def verdict(report: Column) -> Column:
    """The verdict of a verification report: PASS, FAIL, BLOCKED, or "none" (F24)."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(report, r"(?i)verdict\W+(pass|fail|blocked)", 1)), F.lit("")), F.lit("none"))


def escape_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def simple_type(kind: Column) -> Column:
    """A Java type without package and type parameters."""
    return F.regexp_extract(F.regexp_replace(F.trim(kind), "<.*$", ""), r"([A-Za-z_$][\w$]*)(?:\[\])*$", 1)


def referenced_types(kind: Column) -> Column:
    """Capitalised names inside a type, distinct."""
    return F.array_distinct(F.regexp_extract_all(kind, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), 1))


def json_text(answer: Column) -> Column:
    """A model's answer without fences, from its first { to its last }."""
    bare = F.regexp_replace(answer, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), F.trim(bare))


def asset_text(kind: Column, name: Column, description: Column, exports: Column) -> Column:
    """A card as text; parts that are missing leave no line."""
    return F.concat_ws("\n", F.concat(kind, F.lit(": "), name), F.nullif(F.trim(description), F.lit("")), F.when(F.size(exports) > 0, F.concat(F.lit("exports: "), F.array_join(exports, ", "))))


def or_default(text: Column, default: Column) -> Column:
    """Trimmed text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), default)


def flat_json(text: Column, depth: int = 8) -> Column:
    """A JSON object's scalars as (key, value) pairs by dotted key, in order of key (F29); null if it is no object.

    Each step opens the objects that are left, for depth steps; deeper ones keep their JSON as the value.
    """
    opened = lambda v: F.map_entries(F.from_json(v, "map<string,string>"))
    is_object = lambda v: F.coalesce(v.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))

    def below(e: Column) -> Column:
        inner = F.transform(opened(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(is_object(e["value"]), inner).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    out = opened(text)
    for _ in range(depth - 1):
        out = F.flatten(F.transform(out, below))
    return F.array_sort(out)


def asset_scope(known: Column, path: Column, kind: Column) -> Column:
    """backend or frontend (F27): where the module is known already, else what the kind or the path says.

    known: the scopes of the module, an array; frontend comes first if it has both.
    """
    return (
        F.when(F.array_contains(known, "frontend"), "frontend")
        .when(F.array_contains(known, "backend"), "backend")
        .when(kind == "component", "frontend")
        .when(kind.isin("api", "rpc", "pojo", "starter"), "backend")
        .when(path.rlike("(^|/)packages/"), "frontend")
        .otherwise("backend")
    )
