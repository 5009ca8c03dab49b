"""URL decisions carried over redirect and canonical-link equivalence.

Edges join a page's URL with its normal form (https, lower-case host without www. or m., no port, fragment, tracking
parameters, index page, suffix or closing slash), with its canonical link, with its meta refresh target and with
given redirects. URLs that edges connect are one resource. A rule names a host (it holds for subdomains) or a host and
a path (it holds for what lies below); hosts are compared in lower case, paths as they are. A resource with any allowed
URL is allowed, else with any blocked one blocked.

Links are unescaped and resolved: absolute ones stay, //host/path takes the page's scheme, /path its host, ?query its
path, and others its folder. URLs are numbered by 64-bit hashes, so that connecting them moves numbers only.

Null and empty URLs and ones without a host are resources of their own and get no decision; they link to nothing.
Repeated pages and rows without an id are all answered; each page's links count. Very long URLs and texts are read whole.
Ties: of several links of a kind the first counts, of several verdicts allow. An empty table gives an empty result.
Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table
from .components import components

BLOCK = ("spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "casino-win.example.net", "adult-x.example.com", "ads-track.example.com", "free-bets.example.net")
ALLOW = ("free-bets.example.net/en",)
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^(www|m)\.", "")


def path(url: Column) -> Column:
    whole = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(whole, r"((/index)?\.html?)?/*$", "")


def normal(url: Column) -> Column:
    """The normal form of a URL; null for what has no host."""
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(bare_host(url) != "", F.concat(F.lit("https://"), bare_host(url), path(url), tail))


#: A link's tag, what it must hold, and where its target is.
LINKS = (
    (r"(?is)<link\b[^>]*>", r"""(?is)\brel\s*=\s*["']?canonical\b""", r"(?is)\bhref\s*=\s*[\"\']?([^\"\'\s>]+)"),
    (r"(?is)<meta\b[^>]*>", r"(?is)\bhttp-equiv\s*=\s*[\"\']?refresh\b", r"(?is)\burl\s*=\s*[\"\']?([^\"\'\s>]+)"),
)
AMPERSANDS = ("&amp;", "&#38;", "&#x26;")
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"


def _links(html: Column) -> list[Column]:
    out = []
    for tag, test, target in LINKS:
        first = F.get(F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(test)), 0)  # noqa: B023
        link = F.regexp_extract(first, target, 1)
        for a in AMPERSANDS:
            link = F.replace(link, F.lit(a), F.lit("&"))
        out.append(link)
    return out


def resolved(link: Column, url: Column) -> Column:
    """A page's link as an absolute URL."""
    site = F.regexp_extract(url, _SCHEME + "//[^/?#]*", 0)
    page = F.regexp_extract(url, "^[^?#]*", 0)
    folder = F.when(F.length(page) > F.length(site), F.regexp_replace(page, "[^/]*$", "")).otherwise(F.concat(site, F.lit("/")))
    return (
        F.when(link.rlike(_SCHEME + "//"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, _SCHEME, 0), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )


def _rule(text: str) -> str:
    """A rule with its host in lower case."""
    host_, slash, rest = text.partition("/")
    return host_.lower() + slash + rest.rstrip("/") if rest else host_.lower()


def decide(pages: DataFrame, block: Iterable[str] = BLOCK, allow: Iterable[str] = ALLOW, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, url, resource, decision): the least URL of the page's resource, and allow, block or none.

    redirects: more edges, as columns source and target.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    link = F.explode(F.array(*_links(F.coalesce("html", F.lit("")))))
    linked = base.where("url IS NOT NULL").select("url", link.alias("to")).where((F.col("to") != "") & (host(F.col("url")) != ""))
    edges = linked.select(F.col("url").alias("a"), resolved(F.col("to"), F.col("url")).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b")))
    edges = cut(edges.where("a IS NOT NULL AND b IS NOT NULL"))
    given = base.select("url").union(edges.select("a")).union(edges.select("b")).where("url IS NOT NULL").distinct().select("url", normal(F.col("url")).alias("to"))
    pairs = cut(given)
    number = F.xxhash64
    numbered = pairs.select(number("url").alias("a"), number(F.coalesce("to", "url")).alias("b")).union(edges.select(number("a"), number("b"))).distinct()
    root = components(numbered)
    urls = pairs.select("url").union(pairs.select(F.col("to")).where("to IS NOT NULL")).distinct().withColumn("node", number("url"))
    nodes = cut(urls.join(root, "node"))
    # Rules meet URLs by every suffix of the host and every beginning of the path.
    rules = small(cut(spark.createDataFrame([(_rule(r), 1) for r in block] + [(_rule(r), 2) for r in allow], "rule string, verdict int").groupBy("rule").agg(F.max("verdict").alias("verdict"))))
    labels = F.split(bare_host(F.col("url")), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path(F.col("url")), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    keys = F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    verdicts = nodes.where(bare_host(F.col("url")) != "").select("root", keys.alias("rule")).join(rules, "rule").groupBy("root").agg(F.max("verdict").alias("verdict"))
    resources = nodes.groupBy("root").agg(F.min("url").alias("resource")).join(verdicts, "root", "left")
    named = nodes.select("node", "root").join(resources, "root").select("node", "resource", "verdict")
    decision = F.when(F.col("verdict") == 2, "allow").when(F.col("verdict") == 1, "block").otherwise("none")
    return base.select("page_id", "url", number("url").alias("node")).join(named, "node", "left").select("page_id", "url", F.when(F.col("url").isNotNull(), F.col("resource")).alias("resource"), F.when(F.col("url").isNull(), F.lit("none")).otherwise(decision).alias("decision"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every page."""
    return decide(table(spark, sf_dir, "pages"))


_RULES = ", ".join(f"('{r}', 1)" for r in BLOCK) + ", " + ", ".join(f"('{r}', 2)" for r in ALLOW)


def _quoted(pattern: str) -> str:
    return pattern.replace("\\'", "'").replace('\\"', '"').replace("'", "''")


def _links_sql() -> str:
    out = []
    for tag, test, target in LINKS:
        link = f"regexp_extract(list_filter(regexp_extract_all(html, '{_quoted(tag)}'), lambda t: regexp_matches(t, '{_quoted(test)}'))[1], '{_quoted(target)}', 1)"
        for a in AMPERSANDS:
            link = f"replace({link}, '{a}', '&')"
        out.append(link)
    return f"[{', '.join(out)}]"


def sql(redirects: str = "") -> str:
    """The same by a recursive reach over the edges; redirects: a SELECT of more edges."""
    return rf"""
WITH RECURSIVE linked AS (SELECT url, unnest({_links_sql()}) AS t FROM pages WHERE url IS NOT NULL AND regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) <> ''),
at_ AS (SELECT *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') AS site, regexp_extract(url, '^[^?#]*') AS page FROM linked WHERE t <> ''),
given AS (SELECT url AS a, CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') || t WHEN t LIKE '/%' THEN site || t WHEN t LIKE '?%' THEN page || t
  ELSE CASE WHEN length(page) > length(site) THEN regexp_replace(page, '[^/]*$', '') ELSE site || '/' END || t END AS b FROM at_ {('UNION ' + redirects) if redirects else ''}),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM given UNION SELECT b FROM given),
parts AS (
  SELECT url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '((/index)?\.html?)?/*$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM urls),
edges AS (SELECT * FROM given UNION SELECT url, 'https://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END FROM parts WHERE host <> '' UNION SELECT url, url FROM urls),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS other FROM both_ UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON e.a = r.other),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
place AS (
  SELECT node, root, string_split(regexp_replace(lower(regexp_extract(node, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^(www|m)\.', ''), '.') AS l,
    string_split(regexp_replace(regexp_extract(node, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '((/index)?\.html?)?/*$', ''), '/') AS s FROM root),
hosts AS (SELECT root, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))) AS h, s FROM place WHERE l <> ['']),
keys AS (SELECT root, h, unnest(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[:i], '/'))) AS p FROM hosts),
verdicts AS (SELECT root, max(verdict) AS verdict FROM keys JOIN (VALUES {_RULES}) r(rule, verdict) ON h || p = rule GROUP BY root)
SELECT page_id, p.url, r.root AS resource, CASE verdict WHEN 2 THEN 'allow' WHEN 1 THEN 'block' ELSE 'none' END AS decision
FROM pages p LEFT JOIN root r ON r.node = p.url LEFT JOIN verdicts v ON v.root = r.root"""


SQL = sql()
