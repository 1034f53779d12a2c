"""Asset consolidation, verification, duplicates, progress and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import images as I, labels as L, urls as U
from ..functions.stages import stage
from ..operators import assets as A, verify as V
from ..session import checkpointed
from ..views import view, with_views
from . import duck as D
from .registry import query
from .text_queries import _CLASSIFY_IN, _EXT, _RESP, duck_classify

SITE = "https://img0.example.co.in/"


def refs(spark, sf):
    return A.with_resolved_refs(view(spark, sf, "v_refs"))


def assets(spark, sf):
    return A.consolidate_assets(A.identified_refs(view(spark, sf, "v_refs")))


def identified(spark, sf):
    """References with their canonical URLs, written once for queries that read them more than once."""
    return checkpointed(A.identified_refs(view(spark, sf, "v_refs")))


# References with resolved and canonical URLs, then assets, in SQL.
_R = D.canonical(D.resolved("v_refs", "original_url", "source_page", "resolved_url"), "resolved_url", "canonical_url")
_ORD = "[printf('%020d', page_seq), printf('%020d', path_rank), printf('%020d', ordinal), original_url]"
REFS_CTE = f"""r AS MATERIALIZED (SELECT scan_id, page_seq, path_rank, ordinal, source_page, source_type, original_url, alt_text, title, descriptor, declared_width, element_path, is_lazy, resolved_url, canonical_url, {_ORD} AS o FROM {_R})"""
ASSETS_CTE = """a AS MATERIALIZED (SELECT scan_id, canonical_url, 'img_' || substr(sha1(scan_id || '|' || canonical_url), 1, 20) AS asset_id,
 arg_min(resolved_url, o) AS url, arg_min(original_url, o) AS original_url, arg_min(source_page, o) AS source_page,
 arg_min(alt_text, list_append(o, alt_text)) FILTER (alt_text IS NOT NULL) AS alt_text, arg_min(title, list_append(o, title)) FILTER (title IS NOT NULL) AS title,
 bool_or(is_lazy) AS is_lazy, count(DISTINCT [source_page, source_type, coalesce(descriptor, '-'), element_path]) AS reference_count,
 count(DISTINCT source_page) AS page_count, min(o) AS first_o FROM r GROUP BY scan_id, canonical_url)"""
TYPES_CTE = """t AS (SELECT scan_id, canonical_url, string_agg(source_type, ' + ' ORDER BY o) AS source_types
 FROM (SELECT scan_id, canonical_url, source_type, min(o) AS o FROM r GROUP BY ALL) GROUP BY scan_id, canonical_url)"""
ASSETS = with_views("v_refs") + ", " + REFS_CTE + ", " + ASSETS_CTE


@query("consolidate_assets", ASSETS + ", " + TYPES_CTE + """
SELECT scan_id, canonical_url, asset_id, url, original_url, source_page, alt_text, title, is_lazy, reference_count, page_count, source_types FROM a JOIN t USING (scan_id, canonical_url)""")
def consolidate_assets(spark, sf):
    return assets(spark, sf).select(
        "scan_id", "canonical_url", "asset_id", "url", "original_url", "source_page", "alt_text", "title", "is_lazy",
        "reference_count", "page_count", F.array_join("source_types", " + ").alias("source_types"),
    )


_HTML_REFS = {
    "image": ["img", "srcset", "srcset", "srcset", "lazy-attribute", "lazy-attribute", "og-image", "link-icon", "meta-other", "css-inline",
              "css-inline", "css-inline", "video-poster", "svg-image", "input-image", "meta-other"],
    "geo": ["anchor-href", "data-attribute", "map-embed"],
    "link": ["anchor-href"],
}


@query("all_references", " UNION ALL ".join(
    f"SELECT p_partkey AS page_id, '{t}' AS source_type, '{o}' AS origin, CAST({ts.count(t)} AS BIGINT) AS n FROM part" for o, ts in _HTML_REFS.items() for t in sorted(set(ts))))
def all_references(spark, sf):
    from ..operators import references as R

    pages = view(spark, sf, "v_html")
    found = R.scan_references(pages)
    # One column, not one branch, for the kind: each branch of a union would scan the pages again.
    scanned = found.select("page_id", "source_type", F.when(F.col("geo"), "geo").otherwise("image").alias("origin"))
    links = R.geo_anchors(pages).select("page_id", F.lit("anchor-href").alias("source_type"), F.lit("link").alias("origin"))
    return scanned.unionByName(links).groupBy("page_id", "source_type", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("asset_seq", ASSETS + " SELECT scan_id, asset_id, row_number() OVER (PARTITION BY scan_id ORDER BY first_o, canonical_url) AS seq FROM a")
def asset_seq(spark, sf):
    return A.with_sequence(assets(spark, sf)).select("scan_id", "asset_id", "seq")


@query("scope_references", with_views("v_refs") + f"""
SELECT scan_id, resolved_url, source_page FROM (SELECT *, {D.domain('o_host')} AS dom FROM {D.parts(D.parts(D.resolved('v_refs', 'original_url', 'source_page', 'resolved_url'), 'resolved_url', 'u'), D.q(SITE), 'o')})
WHERE u_host = o_host OR u_host = dom OR u_host LIKE '%.' || dom""")
def scope_references(spark, sf):
    df = refs(spark, sf).withColumn("site", F.lit(SITE))
    return A.in_scope(df, "site").select("scan_id", "resolved_url", "source_page")


@query("asset_cap", ASSETS + """, n AS (SELECT scan_id, asset_id, row_number() OVER (PARTITION BY scan_id ORDER BY first_o, canonical_url) AS seq FROM a)
SELECT scan_id, asset_id, seq, NULL AS issue FROM n WHERE seq <= 1500
UNION ALL SELECT scan_id, NULL, NULL, 'Image limit reached' FROM n GROUP BY scan_id HAVING max(seq) > 1500""")
def asset_cap(spark, sf):
    kept, issues = A.cap_assets(A.with_sequence(assets(spark, sf)), 1500)
    return kept.select("scan_id", "asset_id", "seq", F.lit(None).cast("string").alias("issue")).unionByName(
        issues.select("scan_id", F.lit(None).cast("string").alias("asset_id"), F.lit(None).cast("bigint").alias("seq"), F.col("title").alias("issue"))
    )


@query("assets_since", ASSETS + """
SELECT scan_id, asset_id, seq FROM (SELECT scan_id, asset_id, row_number() OVER (PARTITION BY scan_id ORDER BY first_o, canonical_url) AS seq FROM a) WHERE seq > 100 AND seq <= 1100""")
def assets_since(spark, sf):
    return A.assets_since(A.with_sequence(assets(spark, sf)), since=100, limit=1000).select("scan_id", "asset_id", "seq")


def responses(spark, sf):
    """Responses with what the recorded bodies show: size, hash and header dimensions."""
    df = view(spark, sf, "v_responses")
    body = F.col("body_text").cast("binary")
    return df.select(
        "url", "http_status", "content_type", F.col("width").cast("bigint").alias("declared_length"),
        F.concat("url", F.when(F.col("redirected"), "?moved").otherwise("")).alias("final_url"), "redirected", "truncated",
        F.lit(None).cast("string").alias("error"), "width", "height", F.length(body).cast("bigint").alias("body_length"),
        I.content_hash(body, F.col("truncated")).alias("content_hash"),
        I.geo_sniff(F.concat(F.lit("<kml>"), F.col("body_text")).cast("binary"), F.lit("kml")).alias("sniff"),
    )


def response_assets(spark, sf):
    df = U.with_filename(view(spark, sf, "v_responses").select("seq", "asset_id", "scan_id", "url", "asset_kind"), "url", "filename")
    return stage(df, geo_format=U.geo_format(F.col("filename")), extension=U.any_extension(F.col("filename")))


def verified(spark, sf):
    return V.verify_assets(response_assets(spark, sf), responses(spark, sf))


_W, _H = "coalesce(width, 0)", "coalesce(height, 0)"
VERIFIED_CTE = f"""v AS MATERIALIZED (SELECT seq, asset_id, scan_id, url, asset_kind, filename, extension, geo_format, http_status, mime_type, status, body_text, truncated,
 CASE WHEN http_status IS NULL THEN {D.q(V.FAILED_MESSAGE)} WHEN http_status >= 400 THEN {D.case_map('http_status', K.HTTP_MESSAGES, "'The server responded with HTTP ' || http_status || '.'")}
  WHEN status = 'unsupported' AND asset_kind = 'geo' THEN CASE WHEN mime_type = 'text/html' THEN {D.q(V.HTML_MESSAGE)} ELSE 'The server returned an empty file.' END
  WHEN status = 'unsupported' THEN CASE WHEN mime_type IS NULL THEN {D.q(V.NO_IMAGE_MESSAGE)} ELSE 'The server returned "' || mime_type || '", which is not an image type the scanner can read.' END
  WHEN redirected THEN 'Redirected to ' || url || '?moved' END AS status_message,
 CASE WHEN redirected THEN url || '?moved' END AS final_url,
 CASE WHEN status IN ('available', 'redirected') AND NOT truncated THEN sha256(body_text) END AS content_hash,
 CASE WHEN status IN ('available', 'redirected') AND NOT truncated THEN strlen(body_text) WHEN status IN ('available', 'redirected', 'unsupported') THEN width END AS file_size,
 CASE WHEN shown THEN width END AS width, CASE WHEN shown THEN height END AS height,
 CASE WHEN shown AND width >= 2.4 * height THEN 'panorama' WHEN shown AND width / height > 1.08 THEN 'landscape' WHEN shown AND width / height < 0.92 THEN 'portrait' WHEN shown THEN 'square' ELSE 'unknown' END AS orientation,
 CASE WHEN NOT shown THEN 'unknown' WHEN greatest(width, height) < 100 THEN 'tiny' WHEN greatest(width, height) < 400 THEN 'small' WHEN greatest(width, height) < 1000 THEN 'medium' WHEN greatest(width, height) < 2000 THEN 'large' ELSE 'very-large' END AS size_bucket,
 shown AND (width < 100 OR height < 100) AS below_minimum
FROM (SELECT *, status IN ('available', 'redirected') AND asset_kind = 'image' AND width > 0 AND height > 0 AS shown FROM (
 SELECT *, mime AS mime_type, f AS filename, {_EXT} AS extension, {D.geo_format('f')} AS geo_format,
  CASE WHEN http_status IS NULL OR http_status >= 400 THEN 'unavailable'
   WHEN asset_kind = 'geo' AND (mime = 'text/html' OR body_text IS NULL) THEN 'unsupported'
   WHEN asset_kind = 'image' AND NOT coalesce(mime LIKE 'image/%', width > 0 AND height > 0) THEN 'unsupported'
   WHEN redirected THEN 'redirected' ELSE 'available' END AS status FROM {_RESP})))"""
VERIFIED = with_views("v_responses") + ", " + VERIFIED_CTE
_VCOLS = "seq, asset_id, status, http_status, mime_type, status_message, final_url, content_hash, file_size, width, height, orientation, size_bucket, below_minimum"


@query("verify_assets", VERIFIED + f" SELECT {_VCOLS} FROM v")
def verify_assets(spark, sf):
    return verified(spark, sf).select(*_VCOLS.split(", "))


@query("page_outcomes", with_views("v_responses") + """
SELECT seq, url, outcome, CASE WHEN http_status >= 400 THEN 'HTTP ' || http_status WHEN outcome = 'error' THEN 'Request failed' WHEN outcome = 'skipped' THEN 'Not an HTML page (' || split_part(lower(content_type), ';', 1) || ')' END AS error
FROM (SELECT *, CASE WHEN coalesce(http_status, 999) >= 400 THEN 'error' WHEN content_type IS NULL OR content_type LIKE 'text/html%' THEN 'ok' ELSE 'skipped' END AS outcome FROM v_responses)""")
def page_outcomes(spark, sf):
    return V.page_outcomes(view(spark, sf, "v_responses")).select("seq", "url", "outcome", "error")


DUPLICATES_CTE = """d AS (SELECT * REPLACE (CASE WHEN dup AND status = 'available' THEN 'duplicate' ELSE status END AS status), CASE WHEN dup THEN original END AS duplicate_of
 FROM (SELECT *, coalesce(content_hash IS NOT NULL AND asset_id <> original, FALSE) AS dup FROM (SELECT *, first_value(asset_id) OVER (PARTITION BY scan_id, content_hash ORDER BY seq) AS original FROM v)))"""


@query("content_duplicates", VERIFIED + ", " + DUPLICATES_CTE + " SELECT scan_id, asset_id, dup AS is_duplicate, duplicate_of, status FROM d")
def content_duplicates(spark, sf):
    df = A.mark_content_duplicates(verified(spark, sf))
    return df.select("scan_id", "asset_id", "is_duplicate", "duplicate_of", "status")


_VARIANTS = D.variant("p", "url", "variant_group", "d")


@query("dedupe_stats", VERIFIED + ", " + DUPLICATES_CTE + f"""
SELECT scan_id, sum(1 + seq % 3)::BIGINT AS "references", count(*) AS unique_assets, count_if(dup)::BIGINT AS duplicates, count_if(dup AND content_hash IS NOT NULL)::BIGINT AS by_content_hash,
 count(DISTINCT variant_group) AS variant_groups FROM {_VARIANTS} GROUP BY scan_id""")
def dedupe_stats(spark, sf):
    df = A.mark_content_duplicates(verified(spark, sf)).withColumn("reference_count", F.lit(1) + F.col("seq") % 3)
    return A.dedupe_stats(U.with_variant_group(df, "url"))


@query("variant_groups_rollup", ASSETS + f"""
SELECT scan_id, variant_group, count(*) AS members, arg_max(url, [lpad(CAST(page_count * page_count AS VARCHAR), 20, '0'), url]) AS largest_url
FROM {D.variant('p', 'url', 'variant_group', 'a')} WHERE variant_group IS NOT NULL GROUP BY scan_id, variant_group""")
def variant_groups_rollup(spark, sf):
    df = A.describe_assets(assets(spark, sf))
    df = df.withColumn("width", F.col("page_count")).withColumn("height", F.col("page_count"))
    return A.variant_rollup(df)


@query("images_by_page", ASSETS + f"""
SELECT DISTINCT r.scan_id, r.source_page, asset_id FROM r JOIN (SELECT scan_id, canonical_url, asset_id, {D.filename('p', 'url')} AS f FROM {D.parts('a', 'url', 'p')}) x USING (scan_id, canonical_url) WHERE {D.geo_format('f')} IS NULL""")
def images_by_page(spark, sf):
    r = identified(spark, sf)
    return A.images_by_page(r, A.describe_assets(A.consolidate_assets(r)))


@query("scan_progress", ASSETS + """, x AS (SELECT scan_id, count(*) AS refs FROM r GROUP BY scan_id), y AS (SELECT scan_id, count(*) AS u, count_if(page_count > 1) AS c, count_if(is_lazy) AS ver, sum(page_count) AS b FROM a GROUP BY scan_id),
z AS (SELECT scan_id, count_if(ok) AS good, count_if(NOT ok) AS failed, sum(page_seq) AS pb FROM (SELECT DISTINCT scan_id, page_seq, page_seq % 7 <> 0 AS ok FROM v_refs) GROUP BY scan_id)
SELECT scan_id, good::BIGINT AS pages_scanned, failed::BIGINT AS pages_failed, refs AS "references", u AS unique_assets, (c + greatest(refs - u, 0))::BIGINT AS duplicates, ver::BIGINT AS verified, (b + pb)::BIGINT AS bytes,
 round(least(0.98, least(1, good / 20000) * 0.7 + least(1, ver / greatest(1, u)) * 0.2), 6) AS fraction FROM x JOIN y USING (scan_id) JOIN z USING (scan_id)""")
def scan_progress(spark, sf):
    r = refs(spark, sf)
    a = assets(spark, sf).select(
        "scan_id", (F.col("page_count") > 1).alias("is_duplicate"), F.col("is_lazy").alias("verified"), F.col("page_count").alias("bytes_read")
    )
    pages = view(spark, sf, "v_refs").select("scan_id", "page_seq").distinct().select(
        "scan_id", F.when(F.col("page_seq") % 7 != 0, "ok").otherwise("error").alias("outcome"), F.col("page_seq").alias("bytes"),
        F.lit("crawling").alias("phase"),
    )
    return A.scan_progress(r, a, pages, max_pages=20000)


@query("scan_issues", VERIFIED + f"""
SELECT scan_id, CASE WHEN http_status IS NULL THEN 'network' ELSE 'http' END AS kind, url, 'Unable to retrieve this page.' AS title,
 CASE WHEN http_status IS NULL THEN 'Request failed' ELSE 'HTTP status: ' || http_status || chr(10) || {D.case_map('http_status', K.PAGE_HTTP_DETAILS, D.q(K.PAGE_HTTP_DEFAULT))} END AS detail, http_status
FROM v_responses WHERE http_status IS NULL OR http_status >= 400
UNION ALL SELECT scan_id, 'image', url, 'Image unavailable', status_message, http_status FROM v WHERE status = 'unavailable'""")
def scan_issues(spark, sf):
    pages = V.page_outcomes(view(spark, sf, "v_responses"))
    return V.scan_issues(pages, verified(spark, sf))


@query("downloadable_assets", VERIFIED + " SELECT scan_id, asset_id, status FROM v WHERE status NOT IN ('unavailable', 'unsupported')")
def downloadable_assets(spark, sf):
    return V.downloadable(verified(spark, sf)).select("scan_id", "asset_id", "status")


@query("download_size_estimate", VERIFIED + " SELECT scan_id, sum(file_size)::BIGINT AS known_bytes, count(file_size) AS known, count(*) AS retrievable FROM v WHERE status NOT IN ('unavailable', 'unsupported') GROUP BY scan_id")
def download_size_estimate(spark, sf):
    return V.download_size_estimate(verified(spark, sf))


@query("non_map_images", VERIFIED + ", " + duck_classify(_CLASSIFY_IN) + " SELECT scan_id, count_if(asset_kind = 'image' AND category <> 'map' AND status = 'available')::BIGINT AS other_documents FROM v JOIN cls ON key = seq GROUP BY scan_id")
def non_map_images(spark, sf):
    from .text_queries import classify_assets

    category = classify_assets(spark, sf).select("seq", "category")
    return V.non_map_images(verified(spark, sf).join(category, "seq"))


@query("context_hint_sets", ASSETS + """, h AS (SELECT scan_id, canonical_url, source_type || ' ' || element_path AS hint, min(o) AS o FROM r GROUP BY ALL)
SELECT scan_id, canonical_url, string_agg(hint, ' | ' ORDER BY o, hint) AS hints FROM h GROUP BY scan_id, canonical_url""")
def context_hint_sets(spark, sf):
    r = A.identified_refs(view(spark, sf, "v_refs")).withColumn("context_hint", F.concat_ws(" ", "source_type", "element_path"))
    return A.context_hint_sets(r).select("scan_id", "canonical_url", F.array_join("context_hints", " | ").alias("hints"))


@query("asset_by_id", ASSETS + """
SELECT asset_id, scan_id, r.source_page, source_type, count(*) AS n FROM a JOIN r USING (scan_id, canonical_url) GROUP BY ALL""")
def asset_by_id(spark, sf):
    """The references of every asset by its id: how often each page names it, and in which way."""
    counted = A.identified_refs(view(spark, sf, "v_refs")).groupBy("scan_id", "canonical_url", "source_page", "source_type").agg(F.count(F.lit(1)).alias("n"))
    return A.with_asset_ids(checkpointed(counted)).select("asset_id", "scan_id", "source_page", "source_type", "n")
