"""URL operators over pages, references and the URL audit table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import safety, urls as U
from ..functions.stages import stage
from ..operators.references import page_links
from ..views import view, with_views
from . import duck as D
from .registry import query

REFS = "(SELECT DISTINCT original_url, source_page FROM v_refs)"


def _refs(spark, sf):
    return view(spark, sf, "v_refs").select("original_url", "source_page").distinct()


_HREFS = f"(SELECT DISTINCT page_id, url, ordinal, href FROM {D.page_hrefs()})"


@query("resolve_urls", f"SELECT page_id, ordinal, trim(href) AS original, resolved FROM {D.resolved(_HREFS, 'href', 'url', 'resolved')} WHERE resolved IS NOT NULL")
def resolve_urls(spark, sf):
    from ..sources.html import attribute, tag_elements

    a = tag_elements(view(spark, sf, "pages")).filter(F.col("tag") == "a")
    a = stage(a, href=attribute("href")).filter("href is not null")
    a = U.with_resolved(a, "href", "base_url", "resolved", parsed="base").filter("resolved is not null")
    return a.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.trim("href").alias("original"), "resolved")


@query("canonical_urls", with_views("v_refs") + f"""
SELECT 'page' AS kind, page_id AS key, url, canonical_url FROM {D.canonical('(SELECT page_id, url FROM pages)', 'url', 'canonical_url')}
UNION ALL SELECT 'ref', ordinal, original_url, canonical_url FROM {D.canonical('(SELECT DISTINCT ordinal, original_url FROM v_refs)', 'original_url', 'canonical_url')}""")
def canonical_urls(spark, sf):
    pages = view(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), "url")
    refs = view(spark, sf, "v_refs").select(F.lit("ref").alias("kind"), F.col("ordinal").alias("key"), F.col("original_url").alias("url"))
    return U.with_canonical(pages.unionByName(refs.distinct()), "url", "canonical_url")


@query("canonical_page_urls", f"SELECT page_id, url, canonical_url FROM {D.canonical('pages', 'url', 'canonical_url', True)}")
def canonical_page_urls(spark, sf):
    return U.with_canonical(view(spark, sf, "pages").select("page_id", "url"), "url", "canonical_url", page=True)


_LETTERS = "[a-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}]+"
# The insertions of each label and their numbers as window functions, their digits as a recursion.
_HOSTS = f"""
WITH RECURSIVE w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS word FROM documents) WHERE length(word) < strlen(word)),
x AS (SELECT word AS label FROM w UNION SELECT reverse(word) FROM w),
c AS (SELECT label, nth, unicode(substr(label, nth, 1)) AS code FROM (SELECT label, unnest(range(1, length(label) + 1)) AS nth FROM x)),
i AS (SELECT a.label, a.code, a.nth, count(b.nth) AS place FROM c a LEFT JOIN c b ON b.label = a.label AND b.nth < a.nth AND b.code <= a.code WHERE a.code >= 128 GROUP BY ALL),
d AS (SELECT label, k, size + k AS size, (code - before) * (size + k + 1) + place - beyond AS delta
 FROM (SELECT label, code, place, row_number() OVER o - 1 AS k, lag(code, 1, 128) OVER o AS before, lag(place + 1, 1, 0) OVER o AS beyond FROM i WINDOW o AS (PARTITION BY label ORDER BY code, nth))
 JOIN (SELECT label, count(*) FILTER (code < 128) AS size FROM c GROUP BY label) USING (label)),
s AS (SELECT label, k, delta, scaled + scaled // size AS spread
 FROM (SELECT *, lag(delta) OVER (PARTITION BY label ORDER BY k) // CASE WHEN k = 1 THEN 700 ELSE 2 END AS scaled FROM d)),
b AS (SELECT label, k, delta, CASE WHEN k = 0 THEN 72 ELSE 36 * steps + 36 * (spread // pow(35, steps)::BIGINT) // (spread // pow(35, steps)::BIGINT + 38) END AS bias
 FROM (SELECT *, CASE WHEN spread <= 455 THEN 0 WHEN spread // 35 <= 455 THEN 1 WHEN spread // 1225 <= 455 THEN 2 ELSE 3 END AS steps FROM s)),
r AS (SELECT label, k, 0::BIGINT AS j, delta AS q, bias, 0::BIGINT AS digit, TRUE AS more FROM b
 UNION ALL SELECT label, k, j + 1, (q - t) // (36 - t), bias, CASE WHEN q < t THEN q ELSE t + (q - t) % (36 - t) END, q >= t
 FROM (SELECT *, least(greatest(36 * (j + 1) - bias, 1), 26) AS t FROM r WHERE more)),
e AS (SELECT label, 'xn--' || CASE WHEN regexp_matches(label, '[a-z]') THEN regexp_replace(label, '[^a-z]', '', 'g') || '-' ELSE '' END
  || string_agg(substr('abcdefghijklmnopqrstuvwxyz0123456789', digit::INTEGER + 1, 1), '' ORDER BY k, j) AS form FROM r WHERE j > 0 GROUP BY label)
SELECT word, 'https://' || f.form || '.' || g.form || '.example/' AS canonical_url FROM w JOIN e f ON f.label = word JOIN e g ON g.label = reverse(word)"""


@query("unicode_hosts", _HOSTS)
def unicode_hosts(spark, sf):
    """Hosts made of all words with letters beyond ASCII, and their reversed forms, in their canonical URLs."""
    texts = view(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0))).alias("word"))
    words = texts.filter(F.col("word").rlike("[^a-z]")).distinct()
    urls = words.withColumn("url", F.concat(F.lit("https://"), "word", F.lit("."), F.reverse("word"), F.lit(".EXAMPLE:443")))
    return U.with_canonical(urls, "url").select("word", "canonical_url")


def _p(url: str = "original_url", src: str = REFS) -> str:
    return D.parts(src, url, "p")


@query("url_filenames", with_views("v_refs") + f"SELECT DISTINCT original_url, {D.filename('p', 'original_url')} AS filename FROM {_p()}")
def url_filenames(spark, sf):
    df = view(spark, sf, "v_refs").select("original_url").distinct()
    return U.with_filename(df, "original_url", "filename")


@query("url_extensions", with_views("v_refs") + f"""
SELECT DISTINCT original_url, {D.image_extension('f')} AS image_extension, coalesce({D.image_extension('f')}, {D.suffix('f', 2, 8)}) AS extension
FROM (SELECT *, {D.filename('p', 'original_url')} AS f FROM {_p()})""")
def url_extensions(spark, sf):
    df = U.with_filename(view(spark, sf, "v_refs").select("original_url").distinct(), "original_url", "_n")
    n = F.col("_n")
    return df.select("original_url", U.image_extension(n).alias("image_extension"), U.any_extension(n).alias("extension"))


@query("registrable_domains", f"SELECT page_id, p_host AS host, {D.domain('p_host')} AS domain FROM {_p('url', 'pages')}")
def registrable_domains(spark, sf):
    df = U.with_url_parts(view(spark, sf, "pages").select("page_id", "url"), F.col("url"), "p")
    return df.select("page_id", F.col("p_host").alias("host"), U.registrable_domain(F.col("p_host")).alias("domain"))


@query("same_site", f"""
SELECT page_id, link, l_host = p_host AS same_host, l_host = p_host OR l_host = dom OR l_host LIKE '%.' || dom AS same_site
FROM (SELECT *, {D.domain('p_host')} AS dom FROM {D.parts(D.parts(D.page_links(), 'url', 'p'), 'link', 'l')})""")
def same_site(spark, sf):
    df = page_links(view(spark, sf, "pages")).select("page_id", "url", "link")
    df = U.with_url_parts(U.with_url_parts(df, F.col("url"), "p"), F.col("link"), "l")
    hosts = F.col("l_host"), F.col("p_host")
    return df.select("page_id", "link", U.same_site(*hosts, False).alias("same_host"), U.same_site(*hosts, True).alias("same_site"))


@query("page_labels", f"""
SELECT page_id, regexp_replace(p_host, '^www\\.', '') || coalesce(list_aggregate(list_transform(list_filter({D.readable('p_path')}, lambda s: s <> '')[1:4], lambda s: ' → ' || s), 'string_agg', ''), '') AS page_label
FROM {_p('url', 'pages')}""")
def page_labels(spark, sf):
    return U.with_page_label(view(spark, sf, "pages").select("page_id", "url"), "url").select("page_id", "page_label")


@query("url_path_places", f"""
SELECT page_id, coalesce(array_to_string(list_filter({D.readable('p_path')}, lambda s: length(s) > 1 AND length(s) < 60)[1:5], ' > '), '') AS places
FROM {_p('url', 'pages')}""")
def url_path_places(spark, sf):
    df = U.with_url_places(view(spark, sf, "pages").select("page_id", "url"), "url")
    return df.select("page_id", F.array_join("places", " > ").alias("places"))


@query("variant_groups", with_views("v_refs") + f"SELECT DISTINCT original_url, variant_group FROM {D.variant('p', 'original_url', 'variant_group', REFS)}")
def variant_groups(spark, sf):
    return U.with_variant_group(view(spark, sf, "v_refs").select("original_url").distinct(), "original_url")


@query("geo_formats", with_views("v_refs") + f"""
SELECT DISTINCT original_url, {D.geo_format('f')} AS geo_format, {D.geo_format('f')} IS NOT NULL AS is_geo
FROM (SELECT *, {D.filename('p', 'original_url')} AS f FROM {_p()})""")
def geo_formats(spark, sf):
    df = U.with_filename(view(spark, sf, "v_refs").select("original_url").distinct(), "original_url", "_n")
    fmt = U.geo_format(F.col("_n"))
    return df.select("original_url", fmt.alias("geo_format"), fmt.isNotNull().alias("is_geo"))


_LINKS_ALL = D.parts(D.resolved(D.page_hrefs(), "href", "url", "link"), "link", "k")


@query("page_like", f"SELECT page_id, ordinal, link, {D.page_like('k_path')} AS page_like FROM {_LINKS_ALL} WHERE link IS NOT NULL")
def page_like(spark, sf):
    from ..sources.html import attribute, tag_elements

    a = tag_elements(view(spark, sf, "pages")).filter(F.col("tag") == "a")
    a = stage(a, href=attribute("href")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    a = U.with_resolved(a.filter("href is not null"), "href", "base_url", "link", parsed="base").filter("link is not null")
    a = U.with_url_parts(a, F.col("link"), "k")
    return a.select("page_id", "ordinal", "link", U.page_like(F.col("k_path")).alias("page_like"))


@query("asset_ids", with_views("v_refs") + f"""
SELECT DISTINCT scan_id, canonical_url, 'img_' || substr(sha1(scan_id || '|' || canonical_url), 1, 20) AS asset_id,
 'map_' || substr(sha1(canonical_url), 1, 16) AS map_id FROM {D.canonical('v_refs', 'original_url', 'canonical_url')}""")
def asset_ids(spark, sf):
    df = view(spark, sf, "v_refs").select("scan_id", "original_url").distinct()
    df = U.with_canonical(df, "original_url", "canonical_url").select("scan_id", "canonical_url").distinct()
    return df.withColumn("asset_id", U.asset_id(F.col("scan_id"), F.col("canonical_url"))).withColumn(
        "map_id", U.short_id("map", F.col("canonical_url"))
    )


_PORTS = ", ".join(str(p) for p in K.BLOCKED_PORTS)
_TARGET = D.parts(
    "(SELECT s_suppkey, input, CASE WHEN regexp_matches(trim(input), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN trim(input) ELSE 'https://' || trim(input) END AS target FROM v_urls)",
    "target", "p",
)


@query("url_validation", with_views("v_urls") + f"""
SELECT s_suppkey, input, CASE WHEN trim(input) = '' OR length(trim(input)) > 2048 THEN 'invalid-url'
 WHEN lower(regexp_extract(target, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'blocked-protocol'
 WHEN p_host IS NULL THEN 'invalid-url' WHEN p_user <> '' THEN 'blocked-credentials'
 WHEN TRY_CAST(nullif(p_port, '') AS INTEGER) IN ({_PORTS}) THEN 'blocked-port' ELSE 'ok' END AS code,
 CASE WHEN code = 'ok' THEN p_href END AS normalised FROM {_TARGET}""")
def url_validation(spark, sf):
    return safety.validate_targets(view(spark, sf, "v_urls"), "input").select("s_suppkey", "input", "code", "normalised")


_HOSTNAMES = " ".join(f"WHEN regexp_matches(h, {D.q('(?i)' + p)}) THEN {D.q(r)}" for p, r in K.BLOCKED_HOSTNAMES)


@query("host_verdicts", with_views("v_urls") + f"""
SELECT s_suppkey, h AS host, CASE WHEN h = '' THEN 'empty hostname' {_HOSTNAMES} END AS reason
FROM (SELECT *, regexp_replace(coalesce(p_host, ''), '\\.$', '') AS h FROM {_TARGET})""")
def host_verdicts(spark, sf):
    df = safety.validate_targets(view(spark, sf, "v_urls"), "input")
    return safety.host_verdicts(df).select("s_suppkey", "host", "reason")


_V4 = " UNION ALL ".join(
    f"SELECT {i} AS ord, {D.q(c)} AS cidr, {D.q(r)} AS reason" for i, (c, r) in enumerate(K.IPV4_BLOCKS)
)
_V4_INT = lambda x: (
    f"(CAST(split_part({x}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({x}, '.', 2) AS BIGINT) * 65536 "
    f"+ CAST(split_part({x}, '.', 3) AS BIGINT) * 256 + CAST(split_part({x}, '.', 4) AS BIGINT))"
)
_V4_BLOCKS = f"(SELECT ord, reason, {_V4_INT('split_part(cidr, ' + D.q('/') + ', 1)')} AS low, CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INTEGER)) AS BIGINT) AS span FROM ({_V4}))"
_V4_HOSTS = f"(SELECT DISTINCT p_host AS ip, {_V4_INT('p_host')} AS n FROM {_TARGET} WHERE regexp_matches(p_host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$'))"


@query("ipv4_blocks", with_views("v_urls") + f"""
SELECT ip, n = 4294967295 OR min(ord) IS NOT NULL AS blocked, CASE WHEN n = 4294967295 THEN 'broadcast address' ELSE arg_min(reason, ord) END AS reason
FROM {_V4_HOSTS} h LEFT JOIN {_V4_BLOCKS} b ON n >= low AND n < low + span GROUP BY ip, n""")
def ipv4_blocks(spark, sf):
    df = safety.validate_targets(view(spark, sf, "v_urls"), "input")
    df = df.select(F.col("host").alias("ip")).filter(F.col("ip").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")).distinct()
    reason = safety.ipv4_reason(F.col("ip"))
    return df.select("ip", reason.isNotNull().alias("blocked"), reason.alias("reason"))


@query("cidr_lookup", with_views("v_urls") + f"""
SELECT ip, arg_min(reason, ord) AS reason, CAST(min(ord) AS INTEGER) AS rule FROM {_V4_HOSTS} h JOIN {_V4_BLOCKS} b ON n >= low AND n < low + span GROUP BY ip""")
def cidr_lookup(spark, sf):
    df = safety.validate_targets(view(spark, sf, "v_urls"), "input")
    df = df.select(F.col("host").alias("ip")).filter(F.col("ip").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")).distinct()
    return safety.cidr_lookup(df, "ip")


@query("ipv6_blocks", with_views("v_urls") + f"""
SELECT DISTINCT p_host AS ip, CASE WHEN p_host LIKE '[::ffff:127.%' THEN 'IPv4-mapped loopback address' END AS reason
FROM {_TARGET} WHERE p_host LIKE '[%'""")
def ipv6_blocks(spark, sf):
    df = safety.validate_targets(view(spark, sf, "v_urls"), "input")
    df = df.select(F.col("host").alias("ip")).filter(F.col("ip").startswith("[")).distinct()
    return safety.with_ipv6_reason(df, "ip", "reason")
