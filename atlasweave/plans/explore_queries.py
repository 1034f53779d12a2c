"""Filters, facets, sorts, selections and asset exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import archives as AR, assets as A, explore as X, export as E
from ..views import view, with_views
from . import duck as D
from .asset_queries import ASSETS, DUPLICATES_CTE, VERIFIED, assets, verified
from .registry import query
from .text_queries import _CLASSIFY_IN, duck_classify


def catalog(spark, sf):
    """Verified, classified assets with duplicates marked, as the explorer shows them."""
    from .text_queries import classify_assets

    category = classify_assets(spark, sf).select("seq", "category")
    df = A.mark_content_duplicates(verified(spark, sf)).join(category, "seq")
    page = F.concat(F.lit("https://img.example.co.in/pages/p-"), F.floor(F.col("seq") / 10).cast("string"))
    return df.withColumns(
        {
            "source_page": page, "source_page_title": F.lit(None).cast("string"), "source_page_label": page,
            "source_types": F.array(F.lit("img")),
            "alt_text": F.when(F.col("seq") % 4 == 0, F.concat(F.lit('A "quoted", alt '), F.col("seq").cast("string"))),
            "title": F.lit(None).cast("string"), "page_count": F.lit(1), "reference_count": F.lit(1) + F.col("seq") % 3,
        }
    )


_CATALOG = VERIFIED + ", " + DUPLICATES_CTE + ", " + duck_classify(_CLASSIFY_IN) + """, c AS MATERIALIZED (SELECT d.*, category, dup AS is_duplicate,
 'https://img.example.co.in/pages/p-' || CAST(floor(seq / 10) AS BIGINT) AS source_page, CASE WHEN seq % 4 = 0 THEN 'A "quoted", alt ' || seq END AS alt_text,
 CASE WHEN asset_kind = 'geo' AND geo_format IS NOT NULL THEN geo_format WHEN extension = 'jpeg' THEN 'jpg' ELSE coalesce(extension, 'other') END AS format,
 1 + seq % 3 AS reference_count FROM d JOIN cls ON key = seq)"""
_OVERRIDES = "(SELECT 'img_' || p_partkey AS asset_id, CASE WHEN p_size % 2 = 0 THEN 'logo' ELSE 'photo' END AS chosen FROM part WHERE p_brand = 'Brand#1' OR p_type LIKE 'A%')"


def _overrides(spark, sf):
    part = view(spark, sf, "part").filter("p_brand = 'Brand#1' or p_type like 'A%'")
    return part.select(
        F.concat(F.lit("img_"), F.col("p_partkey").cast("string")).alias("asset_id"),
        F.when(F.col("p_size") % 2 == 0, "logo").otherwise("photo").alias("category"),
    )


@query("filter_assets", _CATALOG + """
SELECT seq, asset_id, category FROM c WHERE asset_kind = 'image' AND size_bucket IN ('medium', 'large', 'very-large') AND orientation IN ('landscape', 'panorama', 'portrait')
 AND status IN ('available', 'redirected', 'duplicate') AND format IN ('png', 'svg') AND NOT below_minimum
 AND contains(lower(filename || ' ' || coalesce(alt_text, '') || ' ' || url || ' ' || source_page || ' ' || source_page || ' ' || category || ' img'), 'img')
 AND contains(lower(url), 'maps')""")
def filter_assets(spark, sf):
    filters = X.AssetFilters(
        search="img MAPS", kinds=["image"], sizes=["medium", "large", "very-large"], orientations=["landscape", "panorama", "portrait"],
        statuses=["available", "redirected", "duplicate"], types=["png", "svg"],
    )
    return X.filter_assets(catalog(spark, sf), filters).select("seq", "asset_id", "category")


@query("filter_assets_by_page", _CATALOG + """
SELECT seq, asset_id FROM c WHERE NOT is_duplicate AND source_page IN ('https://img.example.co.in/pages/p-1', 'https://img.example.co.in/pages/p-7')""")
def filter_assets_by_page(spark, sf):
    df = catalog(spark, sf)
    pages = [f"https://img.example.co.in/pages/p-{n}" for n in (1, 7)]
    filters = X.AssetFilters(source_pages=pages, show_duplicates=False, show_below_minimum=True)
    return X.filter_assets(df, filters, references=df.select("asset_id", "source_page")).select("seq", "asset_id")


@query("category_overrides", _CATALOG + f" SELECT seq, coalesce(chosen, category) AS category, chosen IS NOT NULL AS category_was_overridden FROM c LEFT JOIN {_OVERRIDES} USING (asset_id)")
def category_overrides(spark, sf):
    return X.with_category_overrides(catalog(spark, sf), _overrides(spark, sf)).select("seq", "category", "category_was_overridden")


@query("select_by_id", _CATALOG + f" SELECT seq, asset_id FROM c WHERE asset_id IN (SELECT asset_id FROM {_OVERRIDES})")
def select_by_id(spark, sf):
    return X.select_by_id(catalog(spark, sf), _overrides(spark, sf)).select("seq", "asset_id")


_FACETS = f""", o AS (SELECT c.* REPLACE (coalesce(chosen, category) AS category) FROM c LEFT JOIN {_OVERRIDES} USING (asset_id)), f AS (
SELECT 'kind' AS facet, asset_kind AS value, {D.case_map('asset_kind', K.KIND_LABELS, "'Images'")} AS label, count(*) AS count FROM o GROUP BY asset_kind
UNION ALL SELECT 'size', size_bucket, {D.case_map('size_bucket', K.SIZE_LABELS, "'Unknown size'")}, count(*) FROM o GROUP BY size_bucket
UNION ALL SELECT 'category', category, {D.case_map('category', K.CATEGORY_LABELS, "'Unknown'")}, count(*) FROM o GROUP BY category
UNION ALL SELECT 'orientation', orientation, {D.case_map('orientation', K.ORIENTATION_LABELS, "'Unknown'")}, count(*) FROM o GROUP BY orientation
UNION ALL SELECT 'status', status, {D.case_map('status', K.STATUS_LABELS, "'Not verified'")}, count(*) FROM o GROUP BY status
UNION ALL SELECT 'type', format, upper(format), count(*) FROM o GROUP BY format
UNION ALL SELECT 'total', 'below_minimum', 'below_minimum', count(*) FROM o WHERE below_minimum HAVING count(*) > 0
UNION ALL SELECT 'total', 'duplicates', 'duplicates', count(*) FROM o WHERE is_duplicate HAVING count(*) > 0)"""


@query("facets", _CATALOG + _FACETS + " SELECT * FROM f")
def facets(spark, sf):
    return X.facets(X.with_category_overrides(catalog(spark, sf), _overrides(spark, sf)))


@query("sorted_facets", _CATALOG + _FACETS + " SELECT facet, value, count FROM f ORDER BY facet, count DESC, value")
def sorted_facets(spark, sf):
    counts = X.facets(X.with_category_overrides(catalog(spark, sf), _overrides(spark, sf)))
    return X.sorted_facets(counts).select("facet", "value", "count")


_PAGE_COUNTS = "SELECT source_page, count(DISTINCT canonical_url || scan_id) AS count FROM r GROUP BY source_page"
_LABEL = "regexp_replace(source_page, '^https://(site[0-9]+\\.example\\.co\\.in)/maps/p-([0-9]+)$', '\\1 → maps → p \\2')"


@query("facet_pages", ASSETS + f" SELECT source_page, {_LABEL} AS label, count FROM ({_PAGE_COUNTS}) ORDER BY count DESC, source_page LIMIT 200")
def facet_pages(spark, sf):
    from ..functions.urls import asset_id

    r = A.identified_refs(view(spark, sf, "v_refs"))
    return X.facet_pages(r.withColumn("asset_id", asset_id(F.col("scan_id"), F.col("canonical_url"))))


@query("facet_pages_search", ASSETS + f" SELECT * FROM (SELECT source_page, {_LABEL} AS label, count FROM ({_PAGE_COUNTS})) WHERE contains(lower(source_page), 'maps/p-1') OR contains(lower(label), 'maps/p-1') ORDER BY count DESC, source_page LIMIT 40")
def facet_pages_search(spark, sf):
    from ..functions.urls import asset_id

    r = A.identified_refs(view(spark, sf, "v_refs"))
    return X.facet_pages(r.withColumn("asset_id", asset_id(F.col("scan_id"), F.col("canonical_url"))), search="MAPS/p-1")


@query("sort_assets", _CATALOG + """
SELECT seq, filename, array_to_string(list_transform(regexp_extract_all(lower(filename), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '') AS sort_key FROM c ORDER BY sort_key DESC, seq DESC""")
def sort_assets(spark, sf):
    return X.sort_assets(catalog(spark, sf), "filename", descending=True).select("seq", "filename", "sort_key")


def _sort_query(key: str, sql: str):
    @query(f"sort_assets_{key}", _CATALOG + f" SELECT seq, {sql} AS sort_key FROM c ORDER BY sort_key, seq")
    def run(spark, sf):
        return X.sort_assets(catalog(spark, sf), key).select("seq", "sort_key")

    return run


for _key, _sql in {
    "discovered": "seq", "dimensions": "CAST(coalesce(width, 0) AS BIGINT) * coalesce(height, 0)", "filesize": "coalesce(file_size, -1)",
    "type": "format", "source_page": "lower(source_page)", "category": "category",
}.items():
    _sort_query(_key, _sql)


def _csv(x: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '[\",\\r\\n]') THEN '\"' || replace(CAST({x} AS VARCHAR), '\"', '\"\"') || '\"' ELSE CAST({x} AS VARCHAR) END, '')"


_CSV_COLUMNS = ["filename", "url", "source_page", "width", "height", "coalesce(mime_type, extension, '')", "alt_text", "category", "'img'", "status",
                "file_size", "1", "reference_count", "duplicate_of"]


@query("export_csv", _CATALOG + " SELECT seq, " + " || ',' || ".join(_csv(c) for c in _CSV_COLUMNS) + " AS line FROM c")
def export_csv(spark, sf):
    return E.csv_lines(catalog(spark, sf))


@query("export_json", _CATALOG + " SELECT asset_id, json_extract_string(j, '$.url') AS url, json_extract_string(j, '$.category') AS category, CAST(json_extract(j, '$.n') AS BIGINT) AS n FROM (SELECT asset_id, to_json({'url': url, 'category': category, 'n': reference_count}) AS j FROM c)")
def export_json(spark, sf):
    lines = E.json_records(catalog(spark, sf))
    j = lambda p: F.get_json_object("value", p)
    return lines.select("asset_id", j("$.url").alias("url"), j("$.category").alias("category"), j("$.reference_count").cast("bigint").alias("n"))


@query("export_txt", _CATALOG + " SELECT url AS value FROM c ORDER BY seq")
def export_txt(spark, sf):
    return E.text_lines(catalog(spark, sf))


@query("export_cap", ASSETS + " SELECT scan_id, count(*) AS selected, count(*) <= 2000 AS records_ok, count(*) <= 500 AS files_ok, count(*) * 2 + 1 <= 65535 AS entries_ok FROM a GROUP BY scan_id")
def export_cap(spark, sf):
    return E.export_caps(assets(spark, sf), ["scan_id"])


_FREE = "list_filter(range(2, 200), lambda k: NOT list_contains(st.taken, n.stem || ' (' || k || ')' || '.png'))[1]"


@query("unique_entry_names", with_views("v_responses") + f""", n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY seq) AS turn, regexp_replace(name, '\\.png$', '') AS stem FROM (
 SELECT scan_id || '-' || CAST(floor(seq / 100) AS BIGINT) AS archive, seq, coalesce(split_part(p_brand, '#', 1), 'none') || CASE WHEN seq % 7 = 0 THEN ' (2)' ELSE '' END || '.png' AS name FROM v_responses JOIN part ON p_partkey = seq)),
st AS (SELECT archive, seq, turn, name AS entry, [name] AS taken FROM n WHERE turn = 1
 UNION ALL SELECT n.archive, n.seq, n.turn, CASE WHEN list_contains(st.taken, n.name) THEN n.stem || ' (' || {_FREE} || ').png' ELSE n.name END AS e,
  list_append(st.taken, CASE WHEN list_contains(st.taken, n.name) THEN n.stem || ' (' || {_FREE} || ').png' ELSE n.name END) FROM st JOIN n ON n.archive = st.archive AND n.turn = st.turn + 1)
SELECT archive, seq, entry FROM st""")
def unique_entry_names(spark, sf):
    df = view(spark, sf, "v_responses").join(view(spark, sf, "part").withColumnRenamed("p_partkey", "seq"), "seq")
    name = F.concat(F.split_part("p_brand", F.lit("#"), F.lit(1)), F.when(F.col("seq") % 7 == 0, " (2)").otherwise(""), F.lit(".png"))
    archive = F.concat_ws("-", "scan_id", F.floor(F.col("seq") / 100).cast("string"))
    return AR.unique_entry_names(df.select(archive.alias("archive"), "seq", name.alias("name")), ["archive"]).select("archive", "seq", "entry")


def _archive_files(spark, sf):
    df = A.mark_content_duplicates(verified(spark, sf)).filter("status not in ('unavailable', 'unsupported')")
    archive = F.concat_ws("-", "scan_id", F.floor(F.col("seq") / 100).cast("string"))
    return df.select(
        archive.alias("archive"), "seq", "asset_id", "asset_kind", "filename", "url", F.lit("https://img.example.co.in/").alias("source_page"),
        F.when(F.col("seq") % 9 != 0, F.col("file_size") * (F.col("seq") % 40) * 100_000).alias("bytes"),
    )


# The greedy running total as a recursion over each archive's files in order.
_BUDGET = VERIFIED + """, fl AS MATERIALIZED (SELECT scan_id || '-' || CAST(floor(seq / 100) AS BIGINT) AS archive, seq, asset_id, asset_kind, filename, url,
 CASE WHEN seq % 9 <> 0 THEN CAST(file_size * (seq % 40) * 100000 AS BIGINT) END AS bytes, row_number() OVER (PARTITION BY scan_id, floor(seq / 100) ORDER BY seq) AS n
 FROM v WHERE status NOT IN ('unavailable', 'unsupported')),
st AS (SELECT archive, n, asset_id, bytes, CASE WHEN bytes IS NULL THEN 'skipped: request failed' WHEN bytes > 67108864 THEN 'skipped: larger than the 64 MB per-file limit' ELSE 'included' END AS note,
  CAST(CASE WHEN bytes <= 67108864 THEN bytes ELSE 0 END AS BIGINT) AS total FROM fl WHERE n = 1
 UNION ALL SELECT fl.archive, fl.n, fl.asset_id, fl.bytes, CASE WHEN fl.bytes IS NULL THEN 'skipped: request failed' WHEN fl.bytes > 67108864 THEN 'skipped: larger than the 64 MB per-file limit'
  WHEN st.total + fl.bytes > 1073741824 THEN 'skipped: the archive reached its total size limit' ELSE 'included' END,
  CAST(st.total + CASE WHEN fl.bytes <= 67108864 AND st.total + fl.bytes <= 1073741824 THEN fl.bytes ELSE 0 END AS BIGINT) FROM st JOIN fl ON fl.archive = st.archive AND fl.n = st.n + 1)"""


@query("archive_budget", _BUDGET + " SELECT archive, asset_id, bytes, note, total AS running FROM st")
def archive_budget(spark, sf):
    return AR.archive_budget(_archive_files(spark, sf), ["archive"]).select("archive", "asset_id", "bytes", "note", "running")


@query("download_manifest", _BUDGET + """
SELECT fl.archive, CASE WHEN note = 'included' THEN CASE WHEN asset_kind = 'geo' THEN 'geo-data/' ELSE 'images/' END || filename END AS entry, url, fl.bytes, CASE WHEN note = 'included' THEN 'included' ELSE 'skipped' END AS status, note,
 count_if(note = 'included') OVER (PARTITION BY fl.archive)::BIGINT AS files_included, (sum(CASE WHEN note = 'included' THEN fl.bytes END) OVER (PARTITION BY fl.archive))::BIGINT AS total_bytes
FROM st JOIN fl ON fl.archive = st.archive AND fl.n = st.n""")
def download_manifest(spark, sf):
    df = AR.download_manifest(_archive_files(spark, sf), ["archive"])
    return df.select("archive", "entry", "url", "bytes", "status", "note", "files_included", "total_bytes")
