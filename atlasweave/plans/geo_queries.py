"""Geometry, reference systems and geographic files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import crs as C, geometry as G, labels as L, land
from ..functions.stages import stage
from ..operators import kml as KML
from ..sources import geofiles as S
from ..views import view, with_views
from . import duck as D
from .registry import query


def features(spark, sf):
    """``v_features`` with nested geometry, ordered property entries and folder paths."""
    df = view(spark, sf, "v_features")
    p = lambda dx, dy: G.position(F.col("lon0") + dx, F.col("lat0") + dy)
    d = F.col("d")
    zero = F.lit(0.0)
    square = F.array(p(zero, zero), p(d, zero), p(d, d), p(zero, d), p(zero, zero))
    kind = F.col("geometry_type")
    shape = F.when(kind == "Polygon", square).when(kind == "LineString", F.array(p(zero, zero), p(d, d))).otherwise(F.array(p(zero, zero)))
    entry = lambda k, v: F.when(k.isNotNull() & v.isNotNull(), F.struct(k.alias("key"), v.alias("value")))
    entries = F.array_compact(
        F.array(
            entry(F.lit("survey_no"), F.col("prop_survey_no")), entry(F.lit("village"), F.col("prop_village")),
            entry(F.lit("district"), F.col("prop_district")), entry(F.lit("state"), F.col("prop_state")),
            entry(F.col("prop_area_key"), F.col("prop_area_text")),
        )
    )
    return stage(
        df, parts=F.array(F.array(shape)), entries=entries, folder_path=F.array_compact(F.array("folder_1")),
        feature_id=F.concat(F.lit("feat_"), F.substring(F.sha1(F.concat("map_url", F.lit("#"), F.col("ord").cast("string"))), 1, 16)),
        confidence=F.when(F.col("ord") % 13 == 0, "unverified").otherwise("source"),
        source_crs=F.lit(C.WGS84), transformed=F.lit(False), description=F.lit(None).cast("string"),
    )


@query("survey_references", with_views("v_features") + """
SELECT ord, name, coalesce(prop_survey_no, CASE ord % 6 WHEN 0 THEN (ord % 300) || '/' || (ord % 7) WHEN 1 THEN (ord % 90) || '/A' WHEN 2 THEN CAST(ord % 50 AS VARCHAR) WHEN 3 THEN '125/2' END) AS reference FROM v_features""")
def survey_references(spark, sf):
    return features(spark, sf).select("ord", "name", land.survey_reference(F.col("name"), F.col("entries")).alias("reference"))


@query("location_kinds", with_views("v_features") + """
SELECT ord, 'district' AS document_kind, CASE WHEN contains(lower(coalesce(name, '')), 'survey') THEN 'map-area' ELSE 'unknown' END AS name_kind, CASE WHEN prop_village IS NOT NULL THEN 'village' ELSE CASE WHEN contains(lower(coalesce(name, '')), 'survey') THEN 'map-area' ELSE 'unknown' END END AS hinted_kind FROM v_features""")
def location_kinds(spark, sf):
    name = F.coalesce("name", F.lit(""))
    return features(spark, sf).select(
        "ord", land.location_kind(F.col("document_name")).alias("document_kind"), land.location_kind(name).alias("name_kind"),
        land.location_kind(name, F.when(F.col("prop_village").isNotNull(), "gram panchayat")).alias("hinted_kind"),
    )


_STATED = """CASE WHEN prop_area_text = 'n/a' OR CAST(prop_area_text AS DOUBLE) = 0 THEN NULL WHEN prop_area_key = 'area_hectares' THEN CAST(prop_area_text AS DOUBLE) * 10000
 WHEN prop_area_key = 'Area (acre)' THEN CAST(prop_area_text AS DOUBLE) * 4046.8564224 WHEN prop_area_key = 'area_sqm' THEN CAST(prop_area_text AS DOUBLE) END"""
# A closed square: the two sides along parallels carry the whole sum.
_RING = "CASE WHEN geometry_type = 'Polygon' THEN abs((radians(d) * (2 + 2 * sin(radians(lat0))) - radians(d) * (2 + 2 * sin(radians(lat0 + d)))) * 6378137.0 * 6378137.0 / 2) END"


@query("stated_areas", with_views("v_features") + f" SELECT ord, round({_STATED}, 3) AS stated_area FROM v_features")
def stated_areas(spark, sf):
    return features(spark, sf).select("ord", F.round(land.stated_area(F.col("entries")), 3).alias("stated_area"))


@query("geometry_areas", with_views("v_features") + f" SELECT ord, round({_RING}, 1) AS area FROM v_features")
def geometry_areas(spark, sf):
    return features(spark, sf).select("ord", F.round(G.geometry_area(F.col("geometry_type"), F.col("parts")), 1).alias("area"))


@query("parcel_area", with_views("v_features") + f"""
SELECT ord, round(coalesce(s, g), 1) AS area, CASE WHEN s IS NOT NULL THEN 'source-attribute' WHEN g IS NOT NULL THEN 'computed-from-geometry' END AS area_basis
FROM (SELECT ord, {_STATED} AS s, CASE WHEN ord % 13 <> 0 THEN {_RING} END AS g FROM v_features)""")
def parcel_area(spark, sf):
    from ..operators.parcels import with_area

    df = with_area(features(spark, sf))
    return df.select("ord", F.round("area_square_metres", 1).alias("area"), "area_basis")


_SIZE = "CASE WHEN geometry_type = 'Point' THEN 0 ELSE d END"


@query("feature_bbox", with_views("v_features") + f" SELECT ord, round(lon0, 6) AS west, round(lat0, 6) AS south, round(lon0 + {_SIZE}, 6) AS east, round(lat0 + {_SIZE}, 6) AS north FROM v_features")
def feature_bbox(spark, sf):
    df = stage(features(spark, sf), b=G.bbox(F.col("parts")))
    return df.select("ord", *[F.round(f"b.{s}", 6).alias(s) for s in ("west", "south", "east", "north")])


@query("vertex_counts", with_views("v_features") + " SELECT ord, CASE geometry_type WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END AS vertices FROM v_features")
def vertex_counts(spark, sf):
    return features(spark, sf).select("ord", G.vertex_count(F.col("parts")).alias("vertices"))


@query("plausible_positions", with_views("v_features") + """
SELECT ord, CASE geometry_type WHEN 'Polygon' THEN CASE WHEN x + d <= 180 THEN 5 WHEN x <= 180 THEN 3 ELSE 0 END WHEN 'LineString' THEN CASE WHEN x + d <= 180 THEN 2 WHEN x <= 180 THEN 1 ELSE 0 END ELSE CASE WHEN x <= 180 THEN 1 ELSE 0 END END AS kept,
 x + CASE WHEN geometry_type = 'Point' THEN 0 ELSE d END <= 180 AS whole FROM (SELECT *, lon0 + (ord % 3) * 52 AS x FROM v_features)""")
def plausible_positions(spark, sf):
    shifted = F.transform("parts", lambda rs: F.transform(rs, lambda r: F.transform(r, lambda p: G.position(p["lon"] + (F.col("ord") % 3) * 52, p["lat"]))))
    df = stage(features(spark, sf), p=shifted)
    return df.select("ord", F.size(G.keep_plausible(G.positions(F.col("p")))).alias("kept"), G.all_plausible(F.col("p")).alias("whole"))


@query("close_rings", with_views("v_features") + " SELECT ord, geometry_type, CASE WHEN geometry_type = 'Polygon' THEN 5 END AS ring_size, CASE WHEN geometry_type = 'Polygon' THEN 5 END AS reclosed_size FROM v_features")
def close_rings(spark, sf):
    ring = F.get(F.flatten("parts"), 0)
    opened = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    size = lambda r: F.when(r.isNotNull(), F.size(r))
    return features(spark, sf).select("ord", "geometry_type", size(G.close_ring(ring)).alias("ring_size"), size(G.close_ring(opened)).alias("reclosed_size"))


@query("exportable_features", with_views("v_features") + " SELECT ord, ord % 13 <> 0 AS exportable FROM v_features")
def exportable_features(spark, sf):
    return features(spark, sf).select("ord", G.is_exportable(F.col("confidence"), F.col("parts")).alias("exportable"))


@query("drawable_rings", with_views("v_features") + " SELECT ord, 1 AS rings, CASE geometry_type WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END AS first_ring FROM v_features")
def drawable_rings(spark, sf):
    rings = G.drawable_rings(F.col("parts"))
    return features(spark, sf).select("ord", F.size(rings).alias("rings"), F.size(F.get(rings, 0)).alias("first_ring"))


@query("display_units", with_views("v_features") + f"""
SELECT ord, CASE WHEN a IS NULL THEN 'Not available from source' WHEN a >= 10000 THEN printf('%.2f hectares', round(a / 10000, 2)) ELSE format('{{:,}} m²', CAST(floor(a + 0.5) AS BIGINT)) END AS area_text,
 regexp_replace(printf('%.6f', round(lon0, 6)), '\\.?0+$', '') AS lon_text FROM (SELECT *, {_STATED} AS a FROM v_features)""")
def display_units(spark, sf):
    df = stage(features(spark, sf), a=land.stated_area(F.col("entries")))
    return df.select("ord", L.area_text(F.col("a")).alias("area_text"), L.coordinate_text(F.col("lon0")).alias("lon_text"))


@query("kml_coordinates", with_views("v_coords") + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3 AS n_positions, 5 AS decimals, CAST(72 + l_suppkey % 9 AS DOUBLE) + 0.5714 AS first_lon, CAST(20 + l_linenumber AS DOUBLE) + 0.0225 AS first_lat, CAST(0 AS DOUBLE) AS first_alt, 72.1 AS last_lon FROM v_coords""")
def kml_coordinates(spark, sf):
    df = stage(view(spark, sf, "v_coords"), k=G.kml_positions(F.col("kml_text")))
    first = F.get("k.positions", 0)
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size("k.positions").alias("n_positions"), "k.decimals",
        first["lon"].alias("first_lon"), first["lat"].alias("first_lat"), first["alt"].alias("first_alt"), F.get("k.positions", 2)["lon"].alias("last_lon"),
    )


_CODE = """CASE s_suppkey % 10 WHEN 2 THEN 'EPSG:32643' WHEN 4 THEN 'EPSG:3857' WHEN 5 THEN 'EPSG:3857' WHEN 7 THEN 'EPSG:7755' WHEN 8 THEN 'EPSG:3857' WHEN 9 THEN 'EPSG:' || (32600 + s_suppkey) ELSE 'EPSG:4326' END"""
_N = "TRY_CAST(substr(code, 6) AS INTEGER)"
_ZONE = f"CASE WHEN {_N} BETWEEN 32601 AND 32660 THEN {_N} - 32600 WHEN {_N} BETWEEN 32701 AND 32760 THEN 32700 - {_N} END"
_REASON = """'Coordinates are in ' || code || ', which this tool cannot transform exactly. They are left untransformed and the geometry is not offered for export, because reprojecting them incorrectly would move the boundary.'"""


@query("crs_codes", f"SELECT s_suppkey, {_CODE} AS code FROM supplier")
def crs_codes(spark, sf):
    return view(spark, sf, "v_crs").select("s_suppkey", C.crs_code(F.col("raw")).alias("code"))


_SUPPORT = f"""SELECT s_suppkey, supported, code = 'EPSG:4326' AS is_wgs84, CASE WHEN code = 'EPSG:4326' THEN 'WGS 84 (EPSG:4326)' WHEN code = 'EPSG:3857' THEN 'Web Mercator (EPSG:3857)'
 WHEN zone IS NOT NULL THEN 'WGS 84 / UTM zone ' || abs(zone) || CASE WHEN zone > 0 THEN 'N' ELSE 'S' END || ' (' || code || ')' ELSE code END AS label, CASE WHEN NOT supported THEN {_REASON} END AS reason
FROM (SELECT *, {_ZONE} AS zone, code IN ('EPSG:4326', 'EPSG:3857') OR zone IS NOT NULL AS supported FROM (SELECT s_suppkey, {_CODE} AS code FROM supplier))"""


@query("crs_support", _SUPPORT)
def crs_support(spark, sf):
    df = stage(view(spark, sf, "v_crs"), code=C.crs_code(F.col("raw")))
    return stage(df, s=C.crs_support(F.col("code"))).select("s_suppkey", "s.*")


@query("crs_warnings", f"SELECT DISTINCT reason AS warning FROM ({_SUPPORT}) WHERE reason IS NOT NULL")
def crs_warnings(spark, sf):
    df = stage(view(spark, sf, "v_crs"), code=C.crs_code(F.col("raw")))
    return df.select(C.crs_support(F.col("code"))["reason"].alias("warning")).filter("warning is not null").distinct()


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_MERC = "degrees(x / 6378137.0) AS lon, degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2) AS lat"


@query("web_mercator_to_wgs84", with_views("v_coords") + f" SELECT {_KEYS}, round(lon, 7) AS lon, round(lat, 7) AS lat FROM (SELECT {_KEYS}, {_MERC} FROM v_coords)")
def web_mercator_to_wgs84(spark, sf):
    return view(spark, sf, "v_coords").select(
        *_KEYS.split(", "), F.round(C.mercator_lon(F.col("x")), 7).alias("lon"), F.round(C.mercator_lat(F.col("y")), 7).alias("lat")
    )


_E2, _EP2 = C._E2, C._EP2
_FOOT = " + ".join(["mu", *[f"{v!r} * sin({k} * mu)" for k, v in C.FOOTPOINT.items()]])
_UTM = f"""(SELECT *, (abs(zone) * 6 - 183) + degrees((dd - (1 + 2 * tt + cc) * dd * dd * dd / 6 + (5 - 2 * cc + 28 * tt - 3 * cc * cc + 8 * {_EP2!r} + 24 * tt * tt) * pow(dd, 5) / 120) / cos(phi)) AS lon,
 degrees(phi - (nn * tan(phi) / rr) * (dd * dd / 2 - (5 + 3 * tt + 10 * cc - 4 * cc * cc - 9 * {_EP2!r}) * pow(dd, 4) / 24 + (61 + 90 * tt + 298 * cc + 45 * tt * tt - 252 * {_EP2!r} - 3 * cc * cc) * pow(dd, 6) / 720)) AS lat
FROM (SELECT *, (x - 500000) / (nn * 0.9996) AS dd FROM (SELECT *, 6378137.0 / sqrt(1 - {_E2!r} * sin(phi) * sin(phi)) AS nn, pow(tan(phi), 2) AS tt, {_EP2!r} * pow(cos(phi), 2) AS cc,
  6378137.0 * (1 - {_E2!r}) / pow(1 - {_E2!r} * sin(phi) * sin(phi), 1.5) AS rr
 FROM (SELECT *, {_FOOT} AS phi FROM (SELECT *, (CASE WHEN zone > 0 THEN y ELSE y - 10000000 END) / 0.9996 / {C.MERIDIAN!r} AS mu
  FROM (SELECT *, CASE crs WHEN 'EPSG:32643' THEN 43 WHEN 'EPSG:32733' THEN -33 END AS zone FROM v_coords) WHERE zone IS NOT NULL)))))"""


@query("utm_to_wgs84", with_views("v_coords") + f" SELECT {_KEYS}, crs, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {_UTM}")
def utm_to_wgs84(spark, sf):
    df = stage(view(spark, sf, "v_coords"), zone=C.utm_zone(F.col("crs"))).filter("zone is not null")
    df = stage(df, at=C.utm_position(F.col("x"), F.col("y"), F.col("zone")))
    return df.select(*_KEYS.split(", "), "crs", F.round("at.lon", 7).alias("lon"), F.round("at.lat", 7).alias("lat"))


@query("reproject_features", with_views("v_coords") + f"""
SELECT {_KEYS}, crs, round(lon, 6) AS lon, round(lat, 6) AS lat, 'source-transformed' AS confidence FROM {_UTM}
UNION ALL SELECT {_KEYS}, crs, round(lon, 6), round(lat, 6), 'source-transformed' FROM (SELECT *, {_MERC} FROM v_coords WHERE crs = 'EPSG:3857')""")
def reproject_features(spark, sf):
    df = stage(view(spark, sf, "v_coords"), at=C.to_wgs84(F.col("x"), F.col("y"), F.col("crs"))).filter("at is not null")
    return df.select(
        *_KEYS.split(", "), "crs", F.round("at.lon", 6).alias("lon"), F.round("at.lat", 6).alias("lat"),
        F.when(F.col("crs") == C.WGS84, "source").otherwise("source-transformed").alias("confidence"),
    )


@query("mercator_unit", with_views("v_features") + """
SELECT ord, round((lon0 + 180) / 360, 9) AS x, round((1 - ln(tan(radians(lat0)) + 1 / cos(radians(lat0))) / pi()) / 2, 9) AS y FROM v_features""")
def mercator_unit(spark, sf):
    df = stage(features(spark, sf), u=C.mercator_unit(F.col("lon0"), F.col("lat0")))
    return df.select("ord", F.round("u.x", 9).alias("x"), F.round("u.y", 9).alias("y"))


_Y = lambda v: f"((1 - ln(tan(radians({v})) + 1 / cos(radians({v}))) / pi()) / 2)"


@query("viewport_fit", with_views("v_features") + f"""
SELECT ord, round((lon0 + {_SIZE} / 2 + 180) / 360, 9) AS cx, round(({_Y('lat0')} + {_Y('lat0 + ' + _SIZE)}) / 2, 9) AS cy,
 round(greatest(greatest({_SIZE} / 360, 1e-7) / 800, greatest({_Y('lat0')} - {_Y('lat0 + ' + _SIZE)}, 1e-7) / 600) * 1.25 * 1e6, 6) AS scale_millionths FROM (SELECT *, {_SIZE} AS sz FROM v_features)""")
def viewport_fit(spark, sf):
    df = stage(features(spark, sf), b=G.bbox(F.col("parts")))
    df = stage(df, v=C.viewport(F.col("b"), 800, 600))
    return df.select("ord", F.round("v.cx", 9).alias("cx"), F.round("v.cy", 9).alias("cy"), F.round(F.col("v.scale") * 1e6, 6).alias("scale_millionths"))


# --------------------------------------------------------------------------------- files


def kml_bodies(spark, sf):
    return view(spark, sf, "v_kml").select(
        F.col("doc_id").cast("string").alias("asset_id"), "url", F.lit("kml").alias("format"), F.col("body").cast("binary").alias("body")
    )


def _le(value, size):
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def kmz_bodies(spark, sf):
    """Stored archives around the KML documents: every tenth holds no KML, every tenth is cut off."""
    df = view(spark, sf, "v_kml")
    name = F.when(F.col("doc_id") % 10 == 1, "notes.txt").otherwise("doc.kml")
    df = stage(df, _data=F.col("body").cast("binary"), _name=name.cast("binary"))
    size, name_size = F.length("_data"), F.length("_name")
    sums = F.concat(_le(F.crc32("_data"), 4), _le(size, 4), _le(size, 4), _le(name_size, 2))
    local = F.concat(F.lit("504B0304140000000000" + "00000000"), sums, F.lit("0000"), F.hex("_name"), F.hex("_data"))
    central = F.concat(
        F.lit("504B01021400140000000000" + "00000000"), sums, F.lit("0000" + "0000" + "0000" + "0000" + "00000000" + "00000000"), F.hex("_name")
    )
    end = F.concat(F.lit("504B0506" + "0000" + "0000" + "0100" + "0100"), _le(F.lit(46) + name_size, 4), _le(F.lit(30) + name_size + size, 4), F.lit("0000"))
    whole = F.unhex(F.concat(local, central, end))
    body = F.when(F.col("doc_id") % 10 == 2, F.substring(whole, 1, 40)).otherwise(whole)
    return df.select(
        F.col("doc_id").cast("string").alias("asset_id"), F.replace(F.col("url"), F.lit(".kml"), F.lit(".kmz")).alias("url"),
        F.lit("kmz").alias("format"), body.alias("body"),
    )


def gpx_bodies(spark, sf):
    return view(spark, sf, "v_gpx").select(
        F.col("doc_id").cast("string").alias("asset_id"), "url", F.lit("gpx").alias("format"), F.col("body").cast("binary").alias("body")
    )


def geojson_bodies(spark, sf):
    return view(spark, sf, "v_geojson").select(
        F.col("doc_id").cast("string").alias("asset_id"), "url", F.lit("geojson").alias("format"), F.col("body").cast("binary").alias("body")
    )


_FID = lambda seed: f"'feat_' || substr(sha1({seed}), 1, 16)"


def _kml_expected(url: str) -> str:
    return f"""SELECT doc_id, {_FID(url + " || '#poly0'")} AS feature_id, 'Survey ' || doc_id || '/1' AS name, 'Plot & yard' AS description, 'Polygon' AS geometry_type, 5 AS vertices,
  lon + 0.5 AS west, lat + 0.25 AS south, lon + 0.6 AS east, lat + 0.35 AS north, 'village=' || name || ';area_sqm=12.5' AS properties, nation || '>' || segment AS folder_path FROM v_kml
 UNION ALL SELECT doc_id, {_FID(url + " || '#multiline1'")}, 'Lines', NULL, 'MultiLineString', 5, 1, 2, 9, 10, '', nation FROM v_kml
 UNION ALL SELECT doc_id, {_FID(url + " || '#point3'")}, NULL, NULL, 'Point', 1, lon + 0.125, lat + 0.5, lon + 0.125, lat + 0.5, '', '' FROM v_kml"""


def _feature_rows(df):
    df = stage(df, b=G.bbox(F.col("parts")))
    pairs = F.transform("entries", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.select(
        F.col("asset_id").cast("bigint").alias("doc_id"), "feature_id", "name", "description", "geometry_type", G.vertex_count(F.col("parts")).alias("vertices"),
        *[F.round(f"b.{s}", 6).alias(s) for s in ("west", "south", "east", "north")],
        F.array_join(pairs, ";").alias("properties"), F.array_join("folder_path", ">").alias("folder_path"),
    )


_ROUNDED = "doc_id, feature_id, name, description, geometry_type, vertices, round(CAST(west AS DOUBLE), 6) AS west, round(CAST(south AS DOUBLE), 6) AS south, round(CAST(east AS DOUBLE), 6) AS east, round(CAST(north AS DOUBLE), 6) AS north, properties, folder_path"


@query("kml_features", with_views("v_kml") + f" SELECT {_ROUNDED} FROM ({_kml_expected('url')})")
def kml_features(spark, sf):
    return _feature_rows(S.xml_features(S.xml_rows(kml_bodies(spark, sf))))


_KMZ_URL = "replace(url, '.kml', '.kmz') || '!doc.kml'"


@query("kmz_features", with_views("v_kml") + f" SELECT {_ROUNDED} FROM ({_kml_expected(_KMZ_URL)}) WHERE doc_id % 10 NOT IN (1, 2)")
def kmz_features(spark, sf):
    return _feature_rows(S.xml_features(S.xml_rows(kmz_bodies(spark, sf))))


@query("kml_overlays", with_views("v_kml") + f"""
SELECT doc_id, {_FID("url || '#overlay0'")} AS overlay_id, 'Scan' AS name, 'https://img.example.org/scan-' || doc_id || '.jpg' AS href, CAST(lat + 1 AS DOUBLE) AS north, CAST(lat AS DOUBLE) AS south,
 CAST(lon + 1 AS DOUBLE) AS east, CAST(lon AS DOUBLE) AS west, CASE WHEN doc_id % 2 = 0 THEN 1.5::DOUBLE END AS rotation FROM v_kml""")
def kml_overlays(spark, sf):
    df = S.kml_overlays(S.xml_rows(kml_bodies(spark, sf)))
    return df.select(F.col("asset_id").cast("bigint").alias("doc_id"), "overlay_id", "name", "href", "north", "south", "east", "west", "rotation")


@query("gpx_features", with_views("v_gpx") + f"""
SELECT doc_id, {_FID("url || '#wpt0'")} AS feature_id, 'Corner' AS name, NULL AS description, 'Point' AS geometry_type, 1 AS vertices, 72.25::DOUBLE AS west, lat + 0.5::DOUBLE AS south, 72.25::DOUBLE AS east, lat + 0.5::DOUBLE AS north, '' AS properties, '' AS folder_path FROM v_gpx
UNION ALL SELECT doc_id, {_FID("url || '#trk0'")}, 'Edge', 'Along the edge', 'LineString', 2, 72.5, lat + 0.5, 72.75, lat + 0.75, '', '' FROM v_gpx""")
def gpx_features(spark, sf):
    return _feature_rows(S.xml_features(S.xml_rows(gpx_bodies(spark, sf))))


@query("geojson_features", with_views("v_geojson") + f"""
SELECT doc_id, {_FID("url || '#0'")} AS feature_id, doc_id || '/1' AS name, NULL AS description, 'Point' AS geometry_type, 1 AS vertices, round(lon, 6) AS west, round(lat, 6) AS south, round(lon, 6) AS east, round(lat, 6) AS north,
 'survey_no=' || doc_id || '/1;area=1.5' AS properties, '' AS folder_path
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN degrees(8065000 / 6378137.0) ELSE 72.5 END AS lon, CASE WHEN doc_id % 3 = 0 THEN degrees(2 * atan(exp(2632000 / 6378137.0)) - pi() / 2) ELSE 23.0 END AS lat FROM v_geojson)
WHERE doc_id % 10 <> 9 AND NOT (doc_id % 3 <> 0 AND doc_id % 7 = 0)""")
def geojson_features(spark, sf):
    return _feature_rows(S.geojson_features(geojson_bodies(spark, sf)))


def all_bodies(spark, sf):
    tag = lambda df, t: df.withColumn("asset_id", F.concat(F.lit(t), F.col("asset_id")))
    gml = gpx_bodies(spark, sf).withColumn("format", F.lit("gml"))
    parts = [tag(kml_bodies(spark, sf), "kml-"), tag(kmz_bodies(spark, sf), "kmz-"), tag(gpx_bodies(spark, sf), "gpx-"),
             tag(geojson_bodies(spark, sf), "geojson-"), tag(gml, "gml-")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_OUT = D.q(K.OUT_OF_RANGE_WARNING)


@query("geo_documents", with_views("v_kml", "v_gpx", "v_geojson") + f"""
SELECT 'kml-' || doc_id AS asset_id, 'kml' AS format, 'Land ' || nation AS document_name, 'EPSG:4326' AS source_crs, CAST(3 AS BIGINT) AS feature_count, {_OUT} AS warnings FROM v_kml
UNION ALL SELECT 'kmz-' || doc_id, 'kmz', CASE WHEN doc_id % 10 NOT IN (1, 2) THEN 'Land ' || nation END, 'EPSG:4326', CASE WHEN doc_id % 10 NOT IN (1, 2) THEN 3 ELSE 0 END,
 CASE doc_id % 10 WHEN 1 THEN {D.q(K.KMZ_NO_KML_WARNING)} WHEN 2 THEN {D.q(K.KMZ_UNREADABLE_WARNING)} ELSE {_OUT} END FROM v_kml
UNION ALL SELECT 'gpx-' || doc_id, 'gpx', 'Walk ' || name, 'EPSG:4326', 2, '' FROM v_gpx
UNION ALL SELECT 'gml-' || doc_id, 'gml', NULL, 'EPSG:4326', 0, 'GML geometry cannot be read by this tool yet.' FROM v_gpx
UNION ALL SELECT 'geojson-' || doc_id, 'geojson', NULL, CASE WHEN doc_id % 10 <> 9 AND doc_id % 3 = 0 THEN 'EPSG:3857' ELSE 'EPSG:4326' END, CASE WHEN doc_id % 10 = 9 OR (doc_id % 3 <> 0 AND doc_id % 7 = 0) THEN 0 ELSE 1 END,
 CASE WHEN doc_id % 10 = 9 THEN {D.q(K.BAD_JSON_WARNING)} WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN {_OUT} ELSE '' END FROM v_geojson""")
def geo_documents(spark, sf):
    df = S.geo_documents(all_bodies(spark, sf))
    return df.select("asset_id", "format", "document_name", "source_crs", "feature_count", F.array_join("warnings", " | ").alias("warnings"))


@query("kml_placemarks", with_views("v_features") + """
SELECT ord, coalesce(name, 'Unnamed feature') AS title, CASE geometry_type WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END AS tuples, CAST(len(list_filter([prop_survey_no, prop_village, prop_district, prop_state, CASE WHEN prop_area_key IS NOT NULL THEN prop_area_text END], lambda x: x IS NOT NULL)) AS INTEGER) AS data_elements,
 CASE geometry_type WHEN 'Polygon' THEN 'Polygon' ELSE geometry_type END AS element, contains(map_url, 'data.example.org') AS has_source FROM v_features WHERE ord % 13 <> 0""")
def kml_placemarks(spark, sf):
    df = KML.placemarks(features(spark, sf).withColumn("geometry_source", F.col("map_url")))
    x = F.col("placemark")
    block = F.regexp_extract(x, r"(?s)<coordinates>\s*(.*?)\s*</coordinates>", 1)
    return df.select(
        "ord", F.regexp_extract(x, "<name>(.*?)</name>", 1).alias("title"), F.size(F.split(block, r"\s+")).alias("tuples"),
        F.size(F.regexp_extract_all(x, F.lit("(<Data )"), F.lit(1))).alias("data_elements"),
        F.regexp_extract(x, r"\]\]></description>\s*(?:(?s)<ExtendedData>.*</ExtendedData>\s*)?<(\w+)>", 1).alias("element"),
        x.contains("Geometry source: https://data.example.org").alias("has_source"),
    )


_NUM = lambda v: f"regexp_replace(regexp_replace(CAST(round({v}, 6) AS VARCHAR), '\\.0$', ''), '^-0$', '0')"


@query("kml_coordinate_text", with_views("v_features") + f"""
SELECT ord, CASE geometry_type WHEN 'Point' THEN {_NUM('lon0')} || ',' || {_NUM('lat0')} ELSE {_NUM('lon0')} || ',' || {_NUM('lat0')} || ' ' || CASE geometry_type WHEN 'LineString' THEN '' ELSE {_NUM('lon0 + d')} || ',' || {_NUM('lat0')} || ' ' END || {_NUM('lon0 + d')} || ',' || {_NUM('lat0 + d')} ||
 CASE geometry_type WHEN 'LineString' THEN '' ELSE ' ' || {_NUM('lon0')} || ',' || {_NUM('lat0 + d')} || ' ' || {_NUM('lon0')} || ',' || {_NUM('lat0')} END END AS coordinates FROM v_features""")
def kml_coordinate_text(spark, sf):
    rounded = F.transform(G.positions(F.col("parts")), lambda p: G.position(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    return features(spark, sf).select("ord", F.array_join(F.transform(rounded, G.position_text), " ").alias("coordinates"))
