"""Text, label and scalar operators over documents, references, responses and bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import images as I, labels as L, text as T, urls as U
from ..functions.stages import stage
from ..views import view, with_views
from . import duck as D
from .registry import query


@query("clean_text", f"SELECT doc_id, {D.clean('text')} AS clean_text, {D.clean('text', 2000)} AS geo_text FROM documents")
def clean_text(spark, sf):
    t = F.col("text")
    return view(spark, sf, "documents").select("doc_id", T.clean_text(t).alias("clean_text"), T.clean_text(t, 2000).alias("geo_text"))


@query("tokenize", f"SELECT doc_id, CAST(len({D.tokens('text')}) AS INTEGER) AS n_tokens, array_to_string({D.tokens('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, sf):
    words = T.tokenize(F.col("text"))
    return stage(view(spark, sf, "documents").select("doc_id", "text"), w=words).select(
        "doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens")
    )


_SIZE = "CAST(width AS BIGINT) * height * height"


@query("format_bytes", with_views("v_responses") + f"""
SELECT seq, size, CASE WHEN size IS NULL THEN '—' WHEN size < 1024 THEN size || ' B'
 ELSE (CASE WHEN v < 10 THEN printf('%.1f', round(v, 1)) ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END) || ' ' || u END AS size_text
FROM (SELECT seq, size, CASE WHEN size < 1048576 THEN size / 1024 WHEN size < 1073741824 THEN size / 1048576 ELSE size / 1073741824 END AS v,
 CASE WHEN size < 1048576 THEN 'KB' WHEN size < 1073741824 THEN 'MB' ELSE 'GB' END AS u
 FROM (SELECT seq, CASE WHEN truncated THEN NULL ELSE {_SIZE} END AS size FROM v_responses))""")
def format_bytes(spark, sf):
    size = F.when(~F.col("truncated"), F.col("width").cast("bigint") * F.col("height") * F.col("height"))
    df = view(spark, sf, "v_responses").select("seq", size.alias("size"))
    return df.withColumn("size_text", T.format_bytes(F.col("size")))


_EXT = f"coalesce({D.image_extension('f')}, {D.suffix('f', 2, 8)})"
_RESP = f"(SELECT *, {D.filename('p', 'url')} AS f, nullif(lower(trim(split_part(content_type, ';', 1))), '') AS mime FROM {D.parts('v_responses', 'url', 'p')})"


def _responses(spark, sf):
    df = U.with_filename(view(spark, sf, "v_responses"), "url", "filename")
    return stage(
        df, extension=U.any_extension(F.col("filename")), geo_format=U.geo_format(F.col("filename")),
        mime_type=L.base_mime(F.col("content_type")),
    )


@query("facet_labels", with_views("v_refs", "v_responses") + f"""
SELECT DISTINCT 'source' AS facet, source_type AS value, {D.case_map('source_type', K.DISCOVERY_LABELS, "'META'")} AS label FROM v_refs
UNION ALL SELECT DISTINCT 'kind', asset_kind, {D.case_map('asset_kind', K.KIND_LABELS, "'Images'")} FROM v_responses
UNION ALL SELECT DISTINCT 'size', b, {D.case_map('b', K.SIZE_LABELS, "'Unknown size'")} FROM (SELECT CASE WHEN width = 0 OR height = 0 THEN 'unknown' WHEN greatest(width, height) < 100 THEN 'tiny' WHEN greatest(width, height) < 400 THEN 'small' WHEN greatest(width, height) < 1000 THEN 'medium' WHEN greatest(width, height) < 2000 THEN 'large' ELSE 'very-large' END AS b FROM v_responses)""")
def facet_labels(spark, sf):
    refs, resp = view(spark, sf, "v_refs"), view(spark, sf, "v_responses")
    size = I.size_bucket(F.col("width"), F.col("height"))
    rows = [
        refs.select(F.lit("source").alias("facet"), F.col("source_type").alias("value")).distinct().withColumn("label", L.discovery_label(F.col("value"))),
        resp.select(F.lit("kind").alias("facet"), F.col("asset_kind").alias("value")).distinct().withColumn("label", L.kind_label(F.col("value"))),
        resp.select(F.lit("size").alias("facet"), size.alias("value")).distinct().withColumn("label", L.size_label(F.col("value"))),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_FORMAT_KEY = f"CASE WHEN asset_kind = 'geo' AND {D.geo_format('f')} IS NOT NULL THEN {D.geo_format('f')} WHEN {_EXT} = 'jpeg' THEN 'jpg' WHEN {_EXT} IS NOT NULL THEN {_EXT} WHEN mime LIKE 'image/%' THEN replace(replace(replace(substr(mime, 7), 'svg+xml', 'svg'), 'x-icon', 'ico'), 'jpeg', 'jpg') ELSE 'other' END"


@query("format_keys", with_views("v_responses") + f"SELECT seq, {_FORMAT_KEY} AS format FROM {_RESP}")
def format_keys(spark, sf):
    key = L.format_key(*[F.col(c) for c in ("asset_kind", "geo_format", "extension", "mime_type")])
    return _responses(spark, sf).select("seq", key.alias("format"))


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("xml_entities", f"SELECT doc_id, md5({_ESC}) AS escaped_md5, md5({D.entities('text')}) AS decoded_md5, length({_ESC}) AS escaped_chars FROM documents")
def xml_entities(spark, sf):
    df = stage(view(spark, sf, "documents").select("doc_id", "text"), e=T.escape_xml(F.col("text")), d=T.decode_entities(F.col("text")))
    return df.select("doc_id", F.md5("e").alias("escaped_md5"), F.md5("d").alias("decoded_md5"), F.length("e").cast("bigint").alias("escaped_chars"))


def _duck_safe(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\\\/]', '_', 'g'), '[^\\w\\s.-]', '', 'g'), '\\s+', '_', 'g')"


def duck_segment(x: str, limit: int = 80) -> str:
    return f"substr(regexp_replace(regexp_replace({_duck_safe(x)}, '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, {limit})"


@query("safe_names", with_views("v_refs") + f"""
SELECT DISTINCT alt_text, original_url, coalesce(nullif({duck_segment("coalesce(nullif(trim(alt_text), ''), 'feature')", 120)}, ''), 'feature') || '.kml' AS kml_name,
 {duck_segment('original_url')} AS segment, coalesce(nullif(substr({_duck_safe('original_url')}, 1, 100), ''), 'map') AS label,
 substr(coalesce(nullif(regexp_replace(regexp_replace(list_filter(string_split(original_url, '/'), lambda s: s NOT IN ('', '.', '..'))[-1], '[<>:"|?*]', '_', 'g'), '^\\.+', ''), ''), 'asset'), 1, 180) AS entry_name
FROM v_refs""")
def safe_names(spark, sf):
    df = view(spark, sf, "v_refs").select("alt_text", "original_url").distinct()
    url = F.col("original_url")
    return df.select(
        "alt_text", "original_url", T.kml_filename(F.col("alt_text"), F.lit("feature")).alias("kml_name"),
        T.safe_segment(url).alias("segment"), T.safe_label(url, 100, "map").alias("label"),
        T.safe_entry_name(url, F.lit("asset")).alias("entry_name"),
    )


@query("http_status_messages", with_views("v_responses") + f"""
SELECT seq, {D.case_map('http_status', K.HTTP_MESSAGES, "'The server responded with HTTP ' || http_status || '.'")} AS message,
 'HTTP status: ' || http_status || chr(10) || {D.case_map('http_status', K.PAGE_HTTP_DETAILS, D.q(K.PAGE_HTTP_DEFAULT))} AS page_detail FROM v_responses""")
def http_status_messages(spark, sf):
    s = F.col("http_status")
    return view(spark, sf, "v_responses").select("seq", L.http_message(s).alias("message"), L.page_http_detail(s).alias("page_detail"))


@query("mime_types", with_views("v_responses") + f"""
SELECT seq, mime, {D.case_map(_EXT, K.MIME_BY_TYPE, f"'image/' || {_EXT}")} AS type_mime, coalesce('.' || nullif(lower(regexp_extract(url, '(?i)\\.([a-z0-9]{{2,5}})(?:$|\\?)', 1)), ''), '.img') AS saved_as FROM {_RESP}""")
def mime_types(spark, sf):
    return _responses(spark, sf).select(
        "seq", F.col("mime_type").alias("mime"), L.mime_of_type(F.col("extension")).alias("type_mime"),
        L.saved_extension(F.col("url"), F.col("mime_type")).alias("saved_as"),
    )


_RATIO = "(width / height)"


@query("image_shape", with_views("v_responses") + f"""
SELECT seq, CASE WHEN width > 0 AND height > 0 THEN round(width / height, 4) END AS aspect_ratio,
 CASE WHEN width = 0 OR height = 0 THEN 'unknown' WHEN {_RATIO} >= 2.4 THEN 'panorama' WHEN {_RATIO} > 1.08 THEN 'landscape' WHEN {_RATIO} < 0.92 THEN 'portrait' ELSE 'square' END AS orientation,
 CASE WHEN width = 0 OR height = 0 THEN 'unknown' WHEN greatest(width, height) < 100 THEN 'tiny' WHEN greatest(width, height) < 400 THEN 'small' WHEN greatest(width, height) < 1000 THEN 'medium' WHEN greatest(width, height) < 2000 THEN 'large' ELSE 'very-large' END AS size_bucket,
 asset_kind = 'image' AND width > 0 AND height > 0 AND (width < 100 OR height < 100) AS below_minimum FROM v_responses""")
def image_shape(spark, sf):
    w, h = F.col("width"), F.col("height")
    return view(spark, sf, "v_responses").select(
        "seq", I.aspect_ratio(w, h).alias("aspect_ratio"), I.orientation(w, h).alias("orientation"),
        I.size_bucket(w, h).alias("size_bucket"), I.below_minimum(F.col("asset_kind"), w, h).alias("below_minimum"),
    )


@query("geo_sniff", with_views("v_bodies") + """
SELECT seq, kind, CASE kind WHEN 'kmz' THEN substr(hex(body), 1, 4) = '504B' WHEN 'geojson' THEN substr(hex(body), 1, 2) IN ('7B', '5B') ELSE FALSE END AS ok,
 CASE WHEN ok THEN NULL WHEN kind = 'kmz' THEN 'The server did not return a zip archive for this file.' WHEN kind = 'geojson' THEN 'The response was not JSON.' ELSE 'The response did not look like a geographic data file.' END AS note FROM v_bodies""")
def geo_sniff(spark, sf):
    df = stage(view(spark, sf, "v_bodies"), s=I.geo_sniff(F.col("body"), F.col("kind")))
    return df.select("seq", "kind", "s.ok", "s.note")


@query("image_dimensions", with_views("v_bodies") + """
SELECT seq, CASE WHEN kind = 'png' THEN 'png' END AS type, CASE WHEN kind = 'png' THEN CAST('0x' || substr(hex(body), 33, 8) AS INTEGER) END AS width,
 CASE WHEN kind = 'png' THEN CAST('0x' || substr(hex(body), 41, 8) AS INTEGER) END AS height FROM v_bodies""")
def image_dimensions(spark, sf):
    df = stage(view(spark, sf, "v_bodies"), s=I.header_size(F.col("body")))
    return df.select("seq", "s.type", "s.width", "s.height")


_HEX = "CAST('0x' || {} AS INTEGER)".format
_JPEG = "regexp_extract(hex(body), '^FFD8.*FFC[02]001108(....)(....)', {})".format  # the last one: earlier ones stand in payloads
_BYTE_AT = lambda n: _HEX(f"substr(hex(body), {2 * n - 1}, 2)")


@query("image_headers", with_views("v_images") + f""", sized AS (SELECT seq, kind, CASE WHEN kind IN (0, 1) THEN 'jpg' WHEN kind IN (3, 4) THEN 'svg' WHEN kind = 6 THEN 'webp' WHEN kind = 7 THEN 'ico' END AS type,
 CASE WHEN kind IN (0, 1) THEN {_HEX(_JPEG(2))} WHEN kind = 3 THEN w WHEN kind = 4 THEN CAST(floor(2 * h * (w / h)) AS INTEGER) WHEN kind = 6 THEN {_BYTE_AT(25)} + 256 * {_BYTE_AT(26)} + 1 WHEN kind = 7 THEN 16 END AS width,
 CASE WHEN kind IN (0, 1) THEN {_HEX(_JPEG(1))} WHEN kind = 3 THEN CAST(round(h * (96 / 72)) AS INTEGER) WHEN kind = 4 THEN 2 * h WHEN kind = 6 THEN {_BYTE_AT(28)} + 1 WHEN kind = 7 THEN {_BYTE_AT(8)} END AS height FROM v_images)
SELECT seq, type, width, height FROM sized""")
def image_headers(spark, sf):
    df = stage(view(spark, sf, "v_images"), s=I.header_size(F.col("body")))
    return df.select("seq", "s.type", "s.width", "s.height")


@query("content_hashes", with_views("v_bodies") + "SELECT seq, CASE WHEN NOT truncated THEN sha256(body) END AS content_hash FROM v_bodies")
def content_hashes(spark, sf):
    return view(spark, sf, "v_bodies").select("seq", I.content_hash(F.col("body"), F.col("truncated")).alias("content_hash"))


def _words(expr: str) -> str:
    return f"list_distinct({D.tokens(expr)})"


def _hits(words, tokens: str) -> str:
    return f"list_filter({D.array(words)}, lambda w: list_contains({tokens}, w))"


def _quoted(hits: str, n: int) -> str:
    return f"list_aggregate(list_transform({hits}[1:{n}], lambda w: '\"' || w || '\"'), 'string_agg', ', ')"


def duck_classify(src: str) -> str:
    """Category by listing every signal as a row and adding up weights."""
    rows = []
    for i, (category, weight, words) in enumerate(K.CATEGORY_KEYWORDS):
        h = _hits(words, "words")
        rows.append((i, f"len({h}) > 0", f"'{category}'", f"{weight} + least(len({h}) - 1, 2)",
                     f"'filename, alt text or markup mentions ' || {_quoted(h, 3)}"))
    pg = _hits(K.MAP_WORDS, "page_words")
    rows.append((10, f"len({_hits(K.MAP_WORDS, 'words')}) > 0 AND len({pg}) > 0", "'map'", f"1 + least(len({pg}), 2)",
                 f"'found on a page about ' || {_quoted(pg, 2)}"))
    for source, category, weight, reason in K.SOURCE_SIGNALS:
        rows.append((20, f"source_type = '{source}'", f"'{category}'", str(weight), D.q(reason)))
    tiny, square = "(w <= 48 AND h <= 48)", "(w <= 128 AND h <= 128 AND abs(w / h - 1) < 0.25)"
    sized, dims = "w > 0 AND h > 0", "w || '×' || h"
    rows += [
        (30, "extension = 'ico' OR mime IN ('image/x-icon', 'image/vnd.microsoft.icon')", "'icon'", "6", "'served as an .ico icon file'"),
        (31, "extension = 'svg' OR mime = 'image/svg+xml'", "CASE WHEN w > 0 AND w <= 64 THEN 'icon' ELSE 'illustration' END", "2", "'vector (SVG) asset'"),
        (32, f"{sized} AND {tiny}", "'icon'", "5", f"'very small (' || {dims} || ')'"),
        (33, f"{sized} AND NOT {tiny} AND {square}", "'icon'", "3", f"'small and square (' || {dims} || ')'"),
        (34, f"{sized} AND NOT {tiny} AND NOT {square} AND w <= 320 AND h <= 320", "'thumbnail'", "2", f"'thumbnail-sized (' || {dims} || ')'"),
        (35, f"{sized} AND w / h >= 3 AND w >= 900", "'background'", "2", "'very wide banner ratio (' || printf('%.1f', round(w / h, 1)) || ':1)'"),
        (36, f"{sized} AND w * h >= 1000000 AND w / h > 0.5 AND w / h < 2", "'photo'", "1", f"'large photographic dimensions (' || {dims} || ')'"),
        (37, f"{sized} AND w * h >= 400000 AND w / h > 0.6 AND w / h < 2.2 AND list_contains(words, 'map')", "'map'", "2", "'large map-shaped raster'"),
        (38, "extension = 'png' AND w > 0 AND w <= 64", "'icon'", "1", "'small PNG, typical of UI iconography'"),
    ]
    signals = " UNION ALL ".join(
        f"SELECT key, {o} AS o, {c} AS category, {w} AS weight, {r} AS reason FROM cls_in WHERE {cond}" for o, cond, c, w, r in rows
    )
    return f"""cls_in AS ({src}), cls_sig AS ({signals}),
cls_cat AS (SELECT key, category, sum(weight) AS weight, min(o) AS first, string_agg(reason, ' | ' ORDER BY o) AS reasons FROM cls_sig GROUP BY key, category),
cls_top AS (SELECT key, arg_min(category, [-weight, first]) AS category, arg_min(reasons, [-weight, first]) AS reasons, max(weight) / sum(weight) AS share FROM cls_cat GROUP BY key),
cls AS (SELECT i.key, coalesce(t.category, 'unknown') AS category, coalesce(round(least(greatest(t.share, 0.2), 0.95), 2), 0) AS confidence,
 coalesce(t.reasons, 'No distinguishing signals were found.') AS reasons FROM cls_in i LEFT JOIN cls_top t USING (key))"""


_CLASSIFY_IN = f"""SELECT seq AS key, {_words("f || ' ' || p_path || ' ' || p_query")} AS words, CAST([] AS VARCHAR[]) AS page_words, NULL AS source_type, {_EXT} AS extension, mime,
 width AS w, height AS h FROM {_RESP}"""
_CLASSIFY_REFS = f"""SELECT DISTINCT ordinal || '/' || page_seq || '/' || path_rank || '/' || coalesce(declared_width, 0) || coalesce('/' || title, '') AS key, {_words("f || ' ' || p_path || ' ' || p_query || ' ' || coalesce(alt_text, '') || ' ' || coalesce(title, '')")} AS words,
 {_words("g_path")} AS page_words, source_type, {_EXT} AS extension, NULL AS mime, declared_width AS w, NULL::INTEGER AS h
 FROM (SELECT *, {D.filename('p', 'original_url')} AS f FROM {D.parts(D.parts('v_refs', 'original_url', 'p'), 'source_page', 'g')})"""


@query("classify_assets", with_views("v_responses") + ", " + duck_classify(_CLASSIFY_IN) + " SELECT key AS seq, category, confidence, reasons FROM cls")
def classify_assets(spark, sf):
    df = _responses(spark, sf).select(
        "seq", "url", "filename", "extension", "mime_type", "width", "height",
        *[F.lit(None).cast("string").alias(c) for c in ("alt_text", "title", "page_url", "page_title")],
        *[F.array().cast("array<string>").alias(c) for c in ("source_types", "context_hints")],
        *[F.lit(None).cast("int").alias(c) for c in ("declared_width", "declared_height")],
    )
    return I.classify(df).select(
        "seq", "category", F.col("category_confidence").alias("confidence"), F.array_join("category_reasons", " | ").alias("reasons")
    )


@query("classify_references", with_views("v_refs") + ", " + duck_classify(_CLASSIFY_REFS) + " SELECT key, category, confidence, reasons FROM cls")
def classify_references(spark, sf):
    df = U.with_filename(view(spark, sf, "v_refs"), "original_url", "filename")
    df = df.select(
        F.concat_ws("/", "ordinal", "page_seq", "path_rank", F.coalesce("declared_width", F.lit(0)), "title").alias("key"), F.col("original_url").alias("url"), "filename",
        U.any_extension(F.col("filename")).alias("extension"), F.lit(None).cast("string").alias("mime_type"),
        *[F.lit(None).cast("int").alias(c) for c in ("width", "height", "declared_height")],
        "alt_text", "title", F.array("source_type").alias("source_types"), F.array().cast("array<string>").alias("context_hints"),
        F.col("source_page").alias("page_url"), F.lit(None).cast("string").alias("page_title"), "declared_width",
    ).distinct()
    return I.classify(df).select(
        "key", "category", F.col("category_confidence").alias("confidence"), F.array_join("category_reasons", " | ").alias("reasons")
    )
