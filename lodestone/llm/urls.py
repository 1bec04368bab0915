"""URL filters over redirect equivalence: block decisions spread over connected aliases, allow comes first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import connected_components

#: Production rules. A host rule covers its subdomains; a prefix rule is held against the normal form.
BLOCKED_HOSTS = ("tionsh.example.net", "thering.example.org")
BLOCKED_PREFIXES = ("therha.example.com/de/",)
ALLOWED_HOSTS = ("therha.example.net",)
ALLOWED_PREFIXES = ("tionsh.example.net/es/",)

CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh[\"']?[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
SCHEME = r"(?i)^([a-z][a-z0-9+.-]*:)?//"


def normal(url: Column) -> Column:
    """The alias form: no scheme, www. or m., fragment, tracking parameter, .html or closing slash; the host in lower case."""
    u = F.regexp_replace(F.trim(url), SCHEME, "")
    u = F.regexp_replace(u, r"#.*$", "")
    host, rest = F.regexp_extract(u, r"^([^/?]*)", 1), F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.lower(host), r"^(www|m)\.", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[A-Za-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(rest, r"&+", "&")
    rest = F.regexp_replace(rest, r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]$", "")
    rest = F.regexp_replace(rest, r"(/|\.html?)$", "")
    return F.concat(host, rest)


def _listed(node: Column, hosts: Sequence[str], prefixes: Sequence[str]) -> Column:
    host, hit = F.regexp_extract(node, r"^([^/?]*)", 1), F.lit(False)
    for h in hosts:
        hit = hit | (host == h) | F.endswith(host, F.lit(f".{h}"))
    for p in prefixes:
        hit = hit | F.startswith(node, F.lit(p))
    return hit


def _without_dots(path: Column) -> Column:
    """A path without "." and ".." segments; ".." at the root stays at the root."""
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, r"/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    parts = F.split(path, "/")
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step)


def resolve(url: Column, target: Column) -> Column:
    """The URL, without its scheme, that a link's target means on the page at url; null for other schemes and places on the page itself."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), SCHEME, ""), r"#.*$", "")
    host, path = F.regexp_extract(bare, r"^([^/?]*)", 1), F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    own, rest = F.regexp_extract(t, r"^([^?#]*)", 1), F.regexp_extract(t, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return (
        F.when(t.rlike(r"(?i)^(https?:)?//"), t)
        .when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (t == "") | F.startswith(t, F.lit("#")), F.lit(None).cast("string"))
        .when(F.startswith(t, F.lit("/")), F.concat(host, _without_dots(own), rest))
        .when(F.startswith(t, F.lit("?")), F.concat(host, path, rest))
        .otherwise(F.concat(host, _without_dots(F.concat(folder, F.lit("/"), own)), rest))
    )


def _targets(url: Column, html: Column) -> Column:
    """Normal forms of what all canonical links and meta refreshes of a page point to."""
    of = lambda tag, value: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1))
    return F.array_distinct(F.array_compact(F.transform(F.concat(of(CANONICAL, HREF), of(REFRESH, TARGET)), lambda t: normal(resolve(url, t)))))


def filter_urls(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    blocked_hosts: Sequence[str] = BLOCKED_HOSTS,
    blocked_prefixes: Sequence[str] = BLOCKED_PREFIXES,
    allowed_hosts: Sequence[str] = ALLOWED_HOSTS,
    allowed_prefixes: Sequence[str] = ALLOWED_PREFIXES,
) -> DataFrame:
    """(page_id, url, component, decision) for each row of pages.

    pages has page_id, url and html; redirects, if given, src_url and dst_url. Other columns are ignored.
    Nodes are the normal forms of URLs; an edge joins a page to every canonical link and meta refresh in its
    HTML, resolved against the page's URL if they are relative (other schemes than HTTP make none, a <base> is
    not read), and a redirect's ends. component is the smallest node of a connected set. A set
    is "allow" if an allow rule holds for any of its nodes, else "block" if a block rule does, else "keep":
    allow always wins, and nodes that are only targets count too.

    A null or blank url belongs to no set: its component is null and its decision "keep". Null html has no
    links. Repeated rows each get a row. An empty table gives none. Only explicit edges go through the
    components loop: aliases that differ in spelling meet in the normal form itself.
    """
    p = pages.select("page_id", "url", F.nullif(normal(F.col("url")), F.lit("")).alias("node"), _targets(F.col("url"), F.coalesce("html", F.lit(""))).alias("targets"))
    edges = p.where("node IS NOT NULL AND size(targets) > 0").select(F.col("node").alias("src"), F.explode("targets").alias("dst"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.nullif(normal(F.col("src_url")), F.lit("")).alias("src"), F.nullif(normal(F.col("dst_url")), F.lit("")).alias("dst")))
    edges = edges.where("src IS NOT NULL AND dst <> '' AND src <> dst").distinct()
    member = connected_components(edges)
    nodes = p.where("node IS NOT NULL").select("node").unionByName(member.select("node")).distinct()
    named = nodes.join(member, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    allow = _listed(F.col("node"), allowed_hosts, allowed_prefixes)
    block = _listed(F.col("node"), blocked_hosts, blocked_prefixes)
    said = named.groupBy("component").agg(F.max(allow).alias("allow"), F.max(block).alias("block"))
    decision = F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("keep")
    by_node = named.join(said, "component").select("node", "component", decision.alias("decision"))
    return p.select("page_id", "url", "node").join(by_node, "node", "left").select("page_id", "url", "component", F.coalesce("decision", F.lit("keep")).alias("decision"))


def with_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's input: pages, of which each third has a relative canonical link, and a redirect table made from them.

    The driver's pages have no such links; these give every page a place in some component without a random draw:
    the URL of page 4k redirects to that of page k, and page 3k + 1 names ./(id div 8).html as canonical.
    """
    link = F.concat(F.lit('<link rel="canonical" href="./'), F.floor(F.col("page_id") / 8).cast("string"), F.lit('.html">'))
    linked = pages.withColumn("html", F.when(F.col("page_id") % 3 == 1, F.concat(F.coalesce("html", F.lit("")), link)).otherwise(F.col("html")))
    ends = pages.select("page_id", "url").where("page_id > 0 AND url IS NOT NULL")
    from_ = ends.where("page_id % 4 = 0").select((F.col("page_id") / 4).cast("bigint").alias("page_id"), F.col("url").alias("src_url"))
    return linked, from_.join(ends, "page_id").select("src_url", F.col("url").alias("dst_url"))


def oracle() -> str:
    """SQL of filter_urls over with_links."""

    def norm(u: str) -> str:
        bare = f"regexp_replace(regexp_replace(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '#.*$', '')"
        host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^(www|m)\\.', ''), ':(80|443)$', '')"
        rest = f"regexp_extract({bare}, '^[^/?]*(.*)$', 1)"
        rest = f"regexp_replace({rest}, '([?&])(utm_[A-Za-z]+|ref)=[^&]*', '\\1', 'g')"
        rest = f"regexp_replace(regexp_replace({rest}, '&+', '&', 'g'), '\\?&', '?', 'g')"
        return f"{host} || regexp_replace(regexp_replace({rest}, '[?&]$', ''), '(/|\\.html?)$', '')"

    def listed(hosts: Sequence[str], prefixes: Sequence[str]) -> str:
        host = "regexp_extract(node, '^([^/?]*)', 1)"
        return " OR ".join([f"{host} = '{h}' OR ends_with({host}, '.{h}')" for h in hosts] + [f"starts_with(node, '{p}')" for p in prefixes])

    def dots(path: str) -> str:
        return f"""list_reduce(string_split({path}, '/'), lambda acc, x:
      CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END)"""

    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, CASE WHEN page_id % 3 = 1 THEN coalesce(html, '') || '<link rel="canonical" href="./' || (page_id // 8)::VARCHAR || '.html">' ELSE coalesce(html, '') END AS html,
    nullif({norm("url")}, '') AS node, regexp_replace(regexp_replace(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '#.*$', '') AS bare FROM pages),
tags AS (
  SELECT node, bare, regexp_extract(unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical["'']?[^>]*>')), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM p
  UNION ALL
  SELECT node, bare, regexp_extract(unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["'']?[^>]*>')), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM p),
links AS (
  SELECT node, replace(t, '&amp;', '&') AS t, regexp_extract(bare, '^([^/?]*)', 1) AS host, regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path,
    regexp_extract(replace(t, '&amp;', '&'), '^([^?#]*)', 1) AS own, regexp_extract(replace(t, '&amp;', '&'), '^[^?#]*(.*)$', 1) AS rest FROM tags),
meant AS (
  SELECT node AS src, CASE WHEN regexp_matches(t, '^(?i)(https?:)?//') THEN t
    WHEN regexp_matches(t, '^(?i)[a-z][a-z0-9+.-]*:') OR t = '' OR starts_with(t, '#') THEN NULL
    WHEN starts_with(t, '/') THEN host || {dots("own")} || rest
    WHEN starts_with(t, '?') THEN host || path || rest
    ELSE host || {dots("regexp_replace(path, '/[^/]*$', '') || '/' || own")} || rest END AS url FROM links),
e AS (
  SELECT DISTINCT src, dst FROM (
    SELECT src, {norm("url")} AS dst FROM meant
    UNION ALL
    SELECT a.node, b.node FROM p a JOIN p b ON a.page_id = 4 * b.page_id WHERE b.page_id > 0)
  WHERE src IS NOT NULL AND dst <> ''),
nodes AS (SELECT node FROM p WHERE node IS NOT NULL UNION SELECT src FROM e UNION SELECT dst FROM e),
reach(node, seen) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT r.node, b.dst FROM reach r JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) b ON b.src = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
said AS (
  SELECT component, bool_or({listed(ALLOWED_HOSTS, ALLOWED_PREFIXES)}) AS a, bool_or({listed(BLOCKED_HOSTS, BLOCKED_PREFIXES)}) AS b
  FROM comp GROUP BY component)
SELECT page_id, url, c.component, CASE WHEN a THEN 'allow' WHEN b THEN 'block' ELSE 'keep' END AS decision
FROM p LEFT JOIN comp c ON p.node = c.node LEFT JOIN said s ON c.component = s.component"""
