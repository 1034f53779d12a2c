"""robots.txt, sitemaps, permissions and reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..operators.references import page_links
from ..sources import robots as S
from ..views import view, with_views
from . import duck as D
from .registry import query

TOKEN = "atlasweave"

# Every third host names our agent; the others only have the general group.
_ROBOTS = "SELECT s_suppkey AS k, 'h' || s_suppkey || '.example.com' AS host FROM supplier"


@query("robots_rules", f"""
SELECT host, CASE WHEN k % 3 = 0 THEN 'atlas' ELSE '*' END AS agent, FALSE AS allow, CASE WHEN k % 3 = 0 THEN '/maps/*.kml$' ELSE '/private/' END AS pattern,
 CASE WHEN k % 3 = 0 THEN 12 ELSE 9 END AS length FROM ({_ROBOTS})""")
def robots_rules(spark, sf):
    return S.robots_rules(view(spark, sf, "v_robots"), TOKEN).select("host", "agent", "allow", "pattern", "length")


@query("robots_settings", f"""
SELECT host, CASE WHEN k % 3 = 0 THEN 'atlas' ELSE '*' END AS agent, CASE WHEN k % 3 <> 0 THEN ((k % 4) + 0.5) * 1000 END AS crawl_delay_ms, 'https://' || host || '/sitemap.xml' AS sitemaps FROM ({_ROBOTS})""")
def robots_settings(spark, sf):
    df = S.robots_settings(view(spark, sf, "v_robots"), TOKEN)
    return df.withColumn("sitemaps", F.array_join("sitemaps", ","))


_REGEX = "'^' || regexp_replace(regexp_replace(regexp_replace(pattern, '\\$$', ''), '([.?+()])', '\\\\\\1', 'g'), '\\*', '.*', 'g')"
_TAIL = "string_split(regexp_replace(pattern, '\\$$', ''), '*')[-1]"
_ALLOWED = with_views("v_rules", "v_rule_urls") + f""", m AS (SELECT u.url, r.allow, r.pattern, [length(pattern), CAST(allow AS INTEGER), -rule_ord] AS k
 FROM (SELECT url, p_host, p_path || p_query AS path FROM {D.parts('v_rule_urls', 'url', 'p')}) u JOIN v_rules r ON r.host = u.p_host
  AND regexp_matches(path, {_REGEX}) AND (pattern NOT LIKE '%$' OR suffix(path, {_TAIL})))"""


@query("robots_allowed", _ALLOWED + " SELECT url, coalesce((SELECT arg_max(allow, k) FROM m WHERE m.url = u.url), TRUE) AS allowed FROM v_rule_urls u")
def robots_allowed(spark, sf):
    return C.robots_allowed(view(spark, sf, "v_rule_urls"), view(spark, sf, "v_rules"), unique=True).select("url", "allowed")


@query("robots_join", _ALLOWED + " SELECT url, arg_max(pattern, k) AS rule, arg_max(allow, k) AS allowed FROM m GROUP BY url")
def robots_join(spark, sf):
    df = C.robots_allowed(view(spark, sf, "v_rule_urls"), view(spark, sf, "v_rules"), unique=True)
    return df.filter("rule is not null").select("url", "rule", "allowed")


_SEED_SITES = "(SELECT s_suppkey AS k, 'h' || s_suppkey || '.example.com' AS site, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS from_k FROM supplier)"


@query("sitemap_seeds", f"""
SELECT site, CAST(n AS BIGINT) AS seed, CASE n WHEN 1 THEN 'https://h' || from_k || '.example.com/a/?x=1&z=2' ELSE 'https://h.example.com/a/index.html?x=1' END AS url,
 CASE n WHEN 1 THEN 'https://h' || from_k || '.example.com/a?x=1&z=2' ELSE 'https://h.example.com/a?x=1' END AS canonical_url
FROM {_SEED_SITES}, (VALUES (1), (2)) v(n) WHERE from_k IN (SELECT s_suppkey FROM supplier)""")
def sitemap_seeds(spark, sf):
    maps = view(spark, sf, "v_sitemaps")
    starts = maps.select(F.regexp_extract("url", "https://([^/]+)/", 1).alias("site"), "url", F.lit(0).alias("pos"))
    return S.sitemap_seeds(starts, maps)


@query("sitemap_frontier", with_views("v_sitemap_tree") + """,
l AS (SELECT url, text LIKE '%<sitemapindex>%' AS is_index, unnest(regexp_extract_all(text, '<loc>([^<]*)</loc>', 1)) AS loc FROM v_sitemap_tree),
r AS (SELECT 'a' || s_suppkey AS site, 'https://tree.example.com/' || s_suppkey || '.xml' AS url FROM supplier WHERE s_suppkey <= 4
 UNION SELECT r.site, l.loc FROM r JOIN l ON l.url = r.url AND l.is_index)
SELECT DISTINCT site, regexp_replace(replace(loc, '?utm_source=map', ''), '/(index.html)?$', '') AS canonical_url FROM r JOIN l USING (url) WHERE NOT is_index""")
def sitemap_frontier(spark, sf):
    """Indexes that name deeper, missing and earlier ones, followed to the end from four starts."""
    starts = view(spark, sf, "supplier").filter("s_suppkey <= 4").select(
        F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("site"), F.format_string("https://tree.example.com/%d.xml", "s_suppkey").alias("url"), F.lit(0).alias("pos"))
    return S.sitemap_seeds(starts, view(spark, sf, "v_sitemap_tree")).select("site", "canonical_url")


@query("crawl_reachability", with_views("v_links") + """, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM v_links WHERE NOT nofollow AND dst NOT LIKE '%.pdf'),
b AS (SELECT 'https://g.example.com/n-0' AS page, 0 AS depth UNION SELECT 'https://g.example.com/n-1', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.page WHERE b.depth < 5)
SELECT page, min(depth) AS depth FROM b GROUP BY page""")
def crawl_reachability(spark, sf):
    seeds = spark.createDataFrame([(f"https://g.example.com/n-{n}",) for n in (0, 1)], "url string")
    return C.crawl_reachability(view(spark, sf, "v_links"), seeds, max_depth=5)


@query("unseen_urls", f"""
SELECT DISTINCT canonical_url FROM {D.canonical(D.page_links(), 'link', 'canonical_url', True)}
EXCEPT SELECT canonical_url FROM {D.canonical('pages', 'url', 'canonical_url', True)}""")
def unseen_urls(spark, sf):
    pages = view(spark, sf, "pages")
    links = U.with_canonical(page_links(pages), "link", "canonical_url", page=True)
    return C.unseen_urls(links, U.with_canonical(pages.select("url"), "url", "canonical_url", page=True))


