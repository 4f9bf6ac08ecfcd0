"""URL rules, and block decisions that spread over redirects and canonical links.

Urls that redirect to each other or name the same canonical url are one component of a graph. A
url's own rule always decides. A url without a rule is blocked if a rule blocks some member of its
component and no rule explicitly allows one; otherwise it is allowed.

Cases: a NULL url, or one without ``://``, has an empty host and path, fits no rule, is in no
component and is allowed. NULL or empty html has no links. Equal urls are one node; repeated rows
stay repeated. Among rules of equal length the smaller text wins, block before allow. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.base import ascii_lower, register, table
from paperloom.llm.graph import connected_components
from paperloom.session import write_through

#: Rules of the registered query: verdict, host, path prefix. Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """Name of a url in the graph: no scheme, no fragment, lower-case host. NULL without ``://``."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), rest))


def _without_dots(full: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments; those at its end leave the folder."""
    parts = F.split(full, "/")
    drop = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
    step = lambda kept, part: F.when(part == "..", drop(kept)).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    folder = F.element_at(parts, -1).isin(".", "..") | (F.size(kept) < 2)
    return F.concat(F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def _absolute(target: Column, base: Column) -> Column:
    """A link's target as a full url, resolved against ``base``; NULL for a bare fragment and for schemes without ``://``."""
    target = F.regexp_replace(target, "&amp;", "&")
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    here = F.when(path(base) == "", "/").otherwise(path(base))
    root = F.concat(F.lit("http://"), host(base))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host(base) == ""), None)
        .when(target.startswith("?"), F.concat(root, here, target))
        .otherwise(F.concat(root, _without_dots(F.concat(F.regexp_extract(here, "^(.*/)", 1), own)), rest))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst`` urls: the canonical links and refresh redirects in the pages' html."""
    tags = F.concat(
        F.transform(F.regexp_extract_all(F.col(html), F.lit(CANONICAL_TAG), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(F.col(html), F.lit(REFRESH_TAG), 0), lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    holds = F.lower(F.col(html)).rlike("canonical|http-equiv")
    found = pages.where(holds).select(F.col(url).alias("src"), F.explode_outer(tags).alias("raw")).where("raw <> ''")
    return found.select("src", _absolute(F.col("raw"), F.col("src")).alias("dst")).where("dst IS NOT NULL")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` to the longest fitting rule; urls without one are left out.

    Hosts are taken apart into their parent domains, so the rules are found by an equi-join and
    may be a table of any size.
    """
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).where("host <> ''")
    fits = parts.select("url", "path", F.explode_outer(suffixes).alias("rule_host")).join(rules, "rule_host").where("startswith(path, rule_path)")
    text = F.concat("rule_host", "rule_path")
    best = F.struct(F.length(text).alias("n"), F.col("verdict").alias("verdict"), text.alias("rule"))
    rank = F.struct(F.length(text), F.col("verdict"), text)
    return fits.groupBy("url").agg(F.max_by(best, rank).alias("best")).select("url", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, host, path, rule, verdict, via`` of every row of ``pages``.

    ``links`` (src, dst) adds known redirects to those that the html shows. ``via`` is the component
    whose verdict decided, NULL where a rule or the default did.
    """
    edges = page_links(pages, url, html)
    if links is not None:
        edges = edges.unionByName(links.select("src", "dst"))
    edges = write_through(edges.distinct(), "links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("url"))
    urls = pages.select(F.col(url).alias("url")).unionAll(ends).where("url IS NOT NULL").distinct()
    own = write_through(own_rules(urls, rules), "rules")

    graph = edges.select(node(F.col("src")).alias("src"), node(F.col("dst")).alias("dst"))
    parts = connected_components(graph, "src", "dst")
    judged = own.select(node(F.col("url")).alias("node"), "verdict").join(parts, "node")
    blocked = (
        judged.groupBy("component")
        .agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
        .where("block AND NOT allow")
        .join(parts, "component")
        .select("node", F.col("component").alias("via"))
    )
    rows = pages.select(key, F.col(url).alias("url"))
    found = rows.join(own, "url", "left").withColumn("node", node(F.col("url"))).join(blocked, "node", "left")
    verdict = F.coalesce("verdict", F.when(F.col("via").isNotNull(), "block"), F.lit("allow"))
    return found.select(
        key,
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        "rule",
        verdict.alias("verdict"),
        F.when(F.col("verdict").isNull(), F.col("via")).alias("via"),
    )


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (
  SELECT page_id, url, html, rest,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
raw AS (
  SELECT url AS src, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1)))) AS target,
    host AS base FROM q),
ends AS (
  SELECT src, CASE WHEN instr(t, '://') > 0 THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || base || t END AS dst
  FROM (SELECT src, base, replace(target, '&amp;', '&') AS t FROM raw WHERE target <> '')),
named AS (
  SELECT url, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    lower(regexp_extract(rest, '^([^/?#]*)', 1)) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node
  FROM (SELECT url, substr(url, instr(url, '://') + 3) AS rest
        FROM (SELECT url FROM pages UNION SELECT src FROM ends WHERE dst IS NOT NULL UNION SELECT dst FROM ends) WHERE instr(url, '://') > 0)),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
own AS (
  SELECT url, node, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule, first(verdict ORDER BY length(rule_host || rule_path) DESC) AS verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url, node),
edges AS (
  SELECT s.node AS a, d.node AS b FROM ends JOIN named s ON s.url = src JOIN named d ON d.url = dst
  UNION SELECT d.node, s.node FROM ends JOIN named s ON s.url = src JOIN named d ON d.url = dst),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
parts AS (SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a),
spread AS (
  SELECT component FROM own JOIN parts USING (node) GROUP BY component HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
SELECT q.page_id, q.host, q.path, own.rule,
  coalesce(own.verdict, CASE WHEN spread.component IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN own.verdict IS NULL THEN spread.component END AS via
FROM q LEFT JOIN own ON own.url = q.url LEFT JOIN named ON named.url = q.url LEFT JOIN parts ON parts.node = named.node
  LEFT JOIN spread ON spread.component = parts.component
"""


@register("op4_url_filter", SQL)
def op4_url_filter(spark, folder):
    """Every page's verdict under the rules and the decisions that reach it over links."""
    return filter_urls(table(spark, folder, "pages"), rule_table(spark, RULES))
