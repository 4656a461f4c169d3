"""URL filters with redirect equivalence.

Rules name a host and the beginning of a path. A page without a rule of its own takes the decision of its aliases. URLs
are nodes. Edges are pages' canonical links and refresh redirects, redirects that are given, and the rewrites that
servers answer with a redirect (scheme, www. and m., a closing slash, .html, index files, tracking parameters,
fragments), one edge a rewrite. Connected components carry decisions: in each, an explicit allow outweighs a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import ascii_lower, materialise
from semloom.llm.components import connected_components

#: Fixed values: (action, host, beginning of the path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rules of up to so many bytes are broadcast.
BROADCAST_BYTES = 8 << 20
_TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rewrites(url: Column) -> list[Column]:
    """A URL and what servers redirect it to, step by step: https and a small-letter host without fragment, no www. or
    m., no tracking or empty parameters and the rest sorted, no index file or .html, no closing slash. All are null where
    it names no host. URLs that end in the same rewritten one are aliases."""
    own, place, query = host(url), path(url), F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    bare = F.regexp_replace(own, r"^(www|m)\.", "")
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))), "&")
    file = F.regexp_replace(place, r"/index(\.[a-z]+)?$|\.html?$", "")
    whole = lambda h, p, q: F.when(bare != "", F.concat(F.lit("https://"), h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
    steps = [whole(own, place, query), whole(bare, place, query), whole(bare, place, kept), whole(bare, file, kept), whole(bare, F.regexp_replace(file, "/+$", ""), kept)]
    return [F.when(bare != "", url), *steps]


def rewrite_edges(urls: DataFrame) -> DataFrame:
    """(src, dst) for each rewrite that changes one of urls (url)."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.get("_steps", i).alias("src"), F.get("_steps", i + 1).alias("dst")))
    flat = urls.select("url").distinct().withColumn("_steps", F.array(*rewrites(F.col("url"))))
    return flat.select(F.explode(steps).alias("e")).select("e.*").filter("src IS NOT NULL AND src <> dst")


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a whole URL."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    top = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^?#]*/)[^/?#]*", 1)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(top, target))
        .when(target != "", F.concat(folder, target))
    )


def _folders(path: Column) -> Column:
    """The empty text and every beginning of a path that ends in a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))).otherwise(""))


def ruled(urls: DataFrame, rules: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """urls (host, path, ...) with rule and action of the longest rule (action, host, path) that fits, else null.

    A rule fits its host and all subdomains of it where the path starts with the rule's. Rules are keyed by host and
    the folder that their path begins with. Each distinct place first meets the suffixes that rules have, then only the
    rules of its suffixes and of its own folders, and keeps the best one. Rules of up to so many bytes,
    summed first, are broadcast; more of them, and all that grows with the urls, are joined by sorting, where a suffix
    with very many hosts is split.
    """
    start = F.coalesce("path", F.lit(""))
    known = rules.select("action", F.col("host").alias("suffix"), start.alias("start"), F.concat("host", start).alias("rule"))
    known = known.filter("suffix IS NOT NULL").withColumn("folder", F.regexp_extract("start", "(?s)^(.*/)?", 0))
    used = known.agg(F.sum(F.octet_length("rule") + F.octet_length("start") + 64)).first()[0] or 0
    dealt = (lambda df: F.broadcast(df)) if used <= most else (lambda df: df.hint("merge"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # by place, not by host: a host with very many pages would be one key
    places = urls.filter("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    places = places.join(dealt(known.select("suffix").distinct()), "suffix").select("host", "path", "suffix", F.explode(_folders(F.col("path"))).alias("folder"))
    met = places.join(dealt(known), ["suffix", "folder"]).filter(F.startswith(F.col("path"), F.col("start")))
    best = met.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("k"), "rule", "action")).alias("_best"))
    best = materialise(best.select("host", "path", "_best.rule", "_best.action"), "best")
    return urls.join(best.hint("merge"), ["host", "path"], "left")


def _targets(html: Column, url: Column) -> Column:
    """The whole URLs of all canonical links and refresh redirects of a page."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), 1) for p in (_CANONICAL, _REFRESH)))
    plain = F.transform(found, lambda t: F.regexp_replace(t, "&(amp|#38|#x26);", "&"))
    return F.transform(plain, lambda t: resolved(t, url))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html), with rules (action, host, path)
    and, if given, redirects (src, dst) between URLs.

    verdict is the action of the page's own longest rule. Without one it is, over all URLs in the page's component,
    allow if a rule allows one, else block if a rule blocks one, else allow. Host and path of a URL that is null or has
    no :// are empty, and such a page is allowed. A null html has no links; all links of a very long one are read. Of
    equally long rules that fit, the first by host and path counts. Repeated rows come back repeated, an empty table
    gives no row, and other columns are not read.
    """
    flat = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), _targets(F.col("html"), F.col("url")).alias("to"))
    flat = materialise(flat, "pages")
    links = flat.select(F.col("url").alias("src"), F.explode("to").alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = materialise(links.filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    ends = links.select(F.explode(F.array("src", "dst")).alias("url"))
    named = flat.select("url").unionByName(ends).filter("url IS NOT NULL").distinct()
    # a rewritten URL is a node of its own; links meet it through the rewrites of their ends
    comps = connected_components(links.filter("src RLIKE '://[^/?#]' AND dst RLIKE '://[^/?#]'").unionByName(rewrite_edges(named)))
    comps = materialise(comps.withColumnRenamed("node", "url"), "components")

    mine = materialise(ruled(flat.select("page_id", "url", "host", "path"), rules), "ruled")
    others = ruled(ends.distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    votes = mine.select("url", "action").unionByName(others.select("url", "action")).filter("action IS NOT NULL AND url IS NOT NULL").distinct()
    decided = votes.join(comps.hint("merge"), "url", "left").groupBy(F.coalesce("component", "url").alias("component")).agg(F.bool_or(F.col("action") == "allow").alias("allowed"))
    decided = materialise(decided, "decided")

    out = mine.join(comps.hint("merge"), "url", "left").withColumn("component", F.coalesce("component", "url")).join(decided.hint("merge"), "component", "left")
    alias = F.when(F.coalesce("allowed", F.lit(True)), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", alias).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "action string, host string, path string"))


#: Pages of the tables have no canonical links and no refreshes, so that rewrites are the only edges and
#: a component holds the URLs of one alias key.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') AS q
  FROM pages
), k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/index(\.[a-z]+)?$|\.html?$', ''), '/+$', '') || '?' ||
    array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') END AS key
  FROM p
), rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY page_id
), v AS (
  SELECT page_id, host, path, rule, action, bool_or(action = 'allow') OVER (PARTITION BY key) AS allowed
  FROM k LEFT JOIN m USING (page_id)
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(allowed, true) THEN 'allow' ELSE 'block' END) AS verdict FROM v
"""
