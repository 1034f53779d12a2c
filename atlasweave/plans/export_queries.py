"""KML, GeoJSON and bundle exports of parcels, and stored-scan retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archives as AR, kml as KML, parcels as P, places as PL, retention as R
from ..sources import geofiles as S
from ..views import view, with_views
from .place_queries import FULL, MODEL, NODES_CTE, PLACES, Model
from .registry import query
from .text_queries import duck_segment


def _placed(model):
    """Exportable parcels with their KML placemark and folder trail."""
    trails = PL.location_trails(model.places)
    rows = model.records.filter("kml_available").join(trails, "location_id", "left")
    rows = rows.withColumn("trail", F.coalesce("trail", "folder_path"))
    return KML.placemarks(rows, website="site.example.co.in", retrieved="2026-01-01")


@query("kml_combined", PLACES + """ SELECT map_id, trail, count(*) AS placemarks, count(DISTINCT coalesce(name0, 'Unnamed feature')) AS titles FROM (SELECT pf.map_id, pf.name AS name0, tr.trail FROM pf JOIN tr USING (location_id) WHERE kml_available) GROUP BY map_id, trail""")
def kml_combined(spark, sf):
    """Combined documents read back: what each folder of each document holds."""
    placed = _placed(Model(spark, sf))
    docs = KML.combined_documents(placed, "map_id", F.concat("map_url", F.lit(" land maps")))
    bodies = docs.select(F.col("map_id").alias("asset_id"), F.col("map_id").alias("url"), F.lit("kml").alias("format"), F.col("kml").cast("binary").alias("body"))
    back = S.xml_features(S.xml_rows(bodies))
    return back.groupBy(F.col("asset_id").alias("map_id"), F.array_join("folder_path", " > ").alias("trail")).agg(
        F.count(F.lit(1)).alias("placemarks"), F.count_distinct("name").alias("titles")
    )


_FILE = f"coalesce(nullif({duck_segment('coalesce(reference, name)', 120)}, ''), parcel_id) || '.kml'"


@query("kml_per_parcel", MODEL + f""", nm AS (SELECT map_id, parcel_id, ord, {_FILE} AS file_name, coalesce(reference, name) AS label, kml_available, source_page, row_number() OVER (PARTITION BY map_id, kml_available, {_FILE} ORDER BY ord) AS turn FROM pf)
SELECT map_id, parcel_id, CASE WHEN kml_available THEN CASE WHEN turn = 1 THEN file_name ELSE regexp_replace(file_name, '\\.kml$', '') || ' (' || turn || ').kml' END END AS entry,
 CASE WHEN NOT kml_available THEN label || ' - geometry could not be verified (' || source_page || ')' END AS skip_line FROM nm""")
def kml_per_parcel(spark, sf):
    records = Model(spark, sf).records
    docs = KML.single_documents(records.withColumn("title", F.col("name")), website="site.example.co.in")
    docs = docs.withColumn("name", KML.kml_filename(F.coalesce("reference", "name"), F.col("parcel_id")))
    named = AR.unique_entry_names(docs.select("map_id", "parcel_id", "ord", "name"), ["map_id"], "name", "ord")
    skipped = KML.export_split(records).filter("not exported")
    none = F.lit(None).cast("string")
    return named.select("map_id", "parcel_id", "entry", none.alias("skip_line")).unionByName(
        skipped.select("map_id", "parcel_id", none.alias("entry"), "skip_line")
    )


@query("map_geojson", MODEL + """ SELECT map_id, parcel_id, name, geometry_type, CASE geometry_type WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END AS positions, CASE WHEN prop_village IS NOT NULL THEN prop_village END AS village FROM pf""")
def map_geojson(spark, sf):
    """GeoJSON features of each map, one per line, read back."""
    df = P.geojson_lines(Model(spark, sf).records)
    get = lambda p: F.get_json_object("value", p)
    return df.select(
        "map_id", get("$.id").alias("parcel_id"), get("$.properties.name").alias("name"), get("$.geometry.type").alias("geometry_type"),
        F.size(F.regexp_extract_all(get("$.geometry.coordinates"), F.lit(r"(\[-?[0-9])"), F.lit(1))).alias("positions"),
        get("$.properties.village").alias("village"),
    )


_BUNDLE = FULL + ", " + NODES_CTE + f""", rec AS (SELECT parcel_id, map_id, coalesce(reference, name) AS label, location_id, kml_available, 'u' AS av FROM pf),
bi AS (SELECT parcel_id, asset_id, CASE WHEN way <= 1 THEN 'verified' WHEN way <= 3 THEN 'probable' ELSE 'unverified' END AS confidence FROM lk WHERE rank = 1),
ir AS (SELECT i.asset_id, i.url, CASE (area / 10000) % 4 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS http_status, area / 10000 = 6 AS truncated FROM img i),
bl AS (SELECT rec.parcel_id, rec.map_id, CASE WHEN kml_available THEN 'Site_Map_Data/KML/' || sub || base || '.kml' END AS kml_path,
  CASE WHEN http_status < 400 AND NOT truncated THEN 'Site_Map_Data/Images/' || sub || base || coalesce('.' || nullif(lower(regexp_extract(url, '(?i)\\.([a-z0-9]{{2,5}})(?:$|\\?)', 1)), ''), '.img') END AS image_path, confidence
 FROM (SELECT *, {duck_segment('label')} AS base FROM rec) rec LEFT JOIN bi USING (parcel_id) LEFT JOIN ir USING (asset_id)
 JOIN (SELECT l.location_id, coalesce((SELECT string_agg({duck_segment('x.name')} || '/', '' ORDER BY x.depth) FROM loc x WHERE x.depth > 0 AND list_contains(l.ids, x.location_id)), '') AS sub FROM loc l) s USING (location_id)),
bs AS (SELECT *, CASE WHEN kml_path IS NOT NULL AND image_path IS NOT NULL THEN 'complete' WHEN kml_path IS NOT NULL OR image_path IS NOT NULL THEN 'partial' ELSE 'failed' END AS status FROM bl)"""


def _layout(spark, sf):
    model = Model(spark, sf, [*Model.LINKED, "ord", "nodes", "location_id", "kml_available", "geometry_availability"])
    trails = PL.location_trails(model.places)
    n = (F.col("width") / 100).cast("int")
    responses = model.images.select(
        "asset_id", "url", F.col("extension").alias("format"),
        F.when(n % 4 == 0, 404).when(n % 4 == 1, F.lit(None)).otherwise(200).alias("http_status"), (n == 6).alias("truncated"),
    )
    return P.bundle_layout(model.records, trails, P.best_images(model.links), "Site_Map_Data", responses)


@query("bundle_layout", _BUNDLE + " SELECT parcel_id, kml_path, image_path, status FROM bs")
def bundle_layout(spark, sf):
    return _layout(spark, sf).select("parcel_id", "kml_path", "image_path", "status")


@query("export_contents", _BUNDLE + """ SELECT map_id, count(*) AS records, count(kml_path) AS with_kml, count(image_path) AS with_image, count_if(status = 'complete')::BIGINT AS complete, count_if(status = 'partial')::BIGINT AS partial, count_if(status = 'failed')::BIGINT AS failed FROM bs GROUP BY map_id""")
def export_contents(spark, sf):
    return P.export_contents(_layout(spark, sf), ["map_id"])


NOW = "1997-01-01 00:00:00"


@query("bounded_logs", with_views("v_scans") + " SELECT owner, scan_id, age::INTEGER AS age FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY started_at DESC, scan_id DESC) AS age FROM v_scans) WHERE age <= 300")
def bounded_logs(spark, sf):
    return R.bounded_log(view(spark, sf, "v_scans"), ["owner"], ["started_at", "scan_id"], 1000, 300).select("owner", "scan_id", "age")


@query("scan_retention", with_views("v_scans") + f""", x AS (SELECT *, status IN ('completed', 'stopped', 'failed') AS fin, fin AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR AS expired FROM v_scans),
y AS (SELECT *, count(*) OVER (PARTITION BY owner) AS stored, row_number() OVER (PARTITION BY owner, fin ORDER BY started_at, scan_id) AS turn FROM x WHERE NOT expired)
SELECT owner, scan_id, CASE WHEN fin AND turn <= stored - 11 THEN 'evicted' ELSE 'kept' END AS fate FROM y UNION ALL SELECT owner, scan_id, 'expired' FROM x WHERE expired""")
def scan_retention(spark, sf):
    now = F.to_timestamp_ntz(F.lit(NOW))
    return R.scan_retention(view(spark, sf, "v_scans"), ["owner"], now).select("owner", "scan_id", "fate")


@query("recent_scans", with_views("v_scans") + " SELECT owner, scan_id, status FROM v_scans ORDER BY started_at DESC, scan_id DESC LIMIT 20")
def recent_scans(spark, sf):
    return R.recent_scans(view(spark, sf, "v_scans")).select("owner", "scan_id", "status")
