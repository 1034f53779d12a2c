"""Coordinate reference systems: names, support and exact conversions to WGS 84."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .labels import lookup

WGS84 = "EPSG:4326"
# Codes that name the same system: fixed values.
ALIASES = {
    "EPSG:900913": "EPSG:3857", "EPSG:102100": "EPSG:3857", "EPSG:3785": "EPSG:3857",
    "EPSG:4979": WGS84, "EPSG:4327": WGS84,
}
_URN = r"(?i)urn:ogc:def:crs:([A-Za-z0-9]+):[^:]*:?([0-9A-Za-z]+)$"
_EPSG = r"(?i)^(?:EPSG[:\s]*)?(\d{4,6})$"


def crs_code(raw: Column) -> Column:
    """Normal form of the many spellings of a reference system; empty means WGS 84."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    authority, code = F.upper(F.regexp_extract(value, _URN, 1)), F.upper(F.regexp_extract(value, _URN, 2))
    number = F.regexp_extract(value, _EPSG, 1)
    bare = F.regexp_replace(F.upper(value), r"\s+", "")
    named = (
        F.when(value == "", WGS84)
        .when((authority == "OGC") & code.isin("CRS84", "84"), WGS84)
        .when(authority != "", F.concat(authority, F.lit(":"), code))
        .when(number != "", F.concat(F.lit("EPSG:"), number))
        .when(bare.isin("WGS84", "CRS84", "WGS1984", "OGC:CRS84"), WGS84)
        .otherwise(bare)
    )
    return lookup(named, ALIASES, named)


def utm_zone(code: Column) -> Column:
    """Signed UTM zone of a code: positive north, negative south, null when not UTM."""
    n = F.regexp_extract(code, r"^EPSG:(\d{5})$", 1).try_cast("int")
    return F.when(n.between(32601, 32660), n - 32600).when(n.between(32701, 32760), 32700 - n)


def unsupported_reason(code: Column) -> Column:
    return F.concat(
        F.lit("Coordinates are in "), code,
        F.lit(
            ", which this tool cannot transform exactly. They are left untransformed and the geometry is not "
            "offered for export, because reprojecting them incorrectly would move the boundary."
        ),
    )


def crs_support(code: Column) -> Column:
    """``struct<supported, is_wgs84, label, reason>`` of a normalised code."""
    zone = utm_zone(code)
    utm_label = F.concat(
        F.lit("WGS 84 / UTM zone "), F.abs(zone).cast("string"), F.when(zone > 0, "N").otherwise("S"),
        F.lit(" ("), code, F.lit(")"),
    )
    label = (
        F.when(code == WGS84, "WGS 84 (EPSG:4326)")
        .when(code == "EPSG:3857", "Web Mercator (EPSG:3857)")
        .when(zone.isNotNull(), utm_label)
        .otherwise(code)
    )
    supported = code.isin(WGS84, "EPSG:3857") | zone.isNotNull()
    return F.struct(
        supported.alias("supported"), (code == WGS84).alias("is_wgs84"), label.alias("label"),
        F.when(~supported, unsupported_reason(code)).alias("reason"),
    )


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / K.EARTH_RADIUS)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / K.EARTH_RADIUS)) * 2 - math.pi / 2)


_E2 = K.WGS84_FLATTENING * (2 - K.WGS84_FLATTENING)
_EP2 = _E2 / (1 - _E2)
_N = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
# Footpoint latitude series: multiples of mu and their coefficients.
FOOTPOINT = {
    2: 3 * _N / 2 - 27 * _N**3 / 32,
    4: 21 * _N**2 / 16 - 55 * _N**4 / 32,
    6: 151 * _N**3 / 96,
    8: 1097 * _N**4 / 512,
}
MERIDIAN = K.EARTH_RADIUS * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256)


def utm_position(x: Column, y: Column, zone: Column) -> Column:
    """``struct<lon, lat>`` of a UTM position: inverse transverse Mercator on the WGS 84 ellipsoid."""
    let = lambda value, then: F.transform(F.array(value), then)[0]
    northing = F.when(zone > 0, y).otherwise(y - 10_000_000)

    def at(f: Column) -> Column:
        phi, d0 = f["phi"], f["d0"]
        curve = 1 - _E2 * F.pow(F.sin(phi), 2)
        radius = K.EARTH_RADIUS / F.sqrt(curve)
        return let(
            F.struct(
                phi.alias("phi"), F.pow(F.tan(phi), 2).alias("t"), (_EP2 * F.pow(F.cos(phi), 2)).alias("c"),
                (d0 / radius).alias("d"), (F.tan(phi) * curve / (1 - _E2)).alias("tilt"),
            ),
            series,
        )

    def series(v: Column) -> Column:
        t, c, d = v["t"], v["c"], v["d"]
        lat = v["phi"] - v["tilt"] * (
            F.pow(d, 2) / 2
            - (5 + 3 * t + 10 * c - 4 * c * c - 9 * _EP2) * F.pow(d, 4) / 24
            + (61 + 90 * t + 298 * c + 45 * t * t - 252 * _EP2 - 3 * c * c) * F.pow(d, 6) / 720
        )
        lon = (
            d - (1 + 2 * t + c) * F.pow(d, 3) / 6
            + (5 - 2 * c + 28 * t - 3 * c * c + 8 * _EP2 + 24 * t * t) * F.pow(d, 5) / 120
        ) / F.cos(v["phi"])
        centre = F.abs(zone) * 6 - 183
        return F.struct((centre + F.degrees(lon)).alias("lon"), F.degrees(lat).alias("lat"))

    mu = northing / K.UTM_SCALE / MERIDIAN
    footpoint = lambda m: m + sum((F.sin(m * k) * v for k, v in FOOTPOINT.items()), F.lit(0.0))
    start = let(mu, lambda m: F.struct(footpoint(m).alias("phi"), ((x - 500_000) / K.UTM_SCALE).alias("d0")))
    return let(start, at)


def to_wgs84(x: Column, y: Column, code: Column) -> Column:
    """``struct<lon, lat>`` in WGS 84; null when the system cannot be converted exactly."""
    zone = utm_zone(code)
    pair = lambda lon, lat: F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    return (
        F.when(code == WGS84, pair(x, y))
        .when(code == "EPSG:3857", pair(mercator_lon(x), mercator_lat(y)))
        .when(zone.isNotNull(), utm_position(x, y, zone))
    )


def mercator_unit(lon: Column, lat: Column) -> Column:
    """``struct<x, y>`` of a position on the unit square of Web Mercator."""
    phi = F.radians(F.greatest(F.lit(-K.MERCATOR_MAX_LATITUDE), F.least(F.lit(K.MERCATOR_MAX_LATITUDE), lat)))
    return F.struct(
        ((lon + 180) / 360).alias("x"),
        ((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2).alias("y"),
    )


def viewport(bbox: Column, width: int, height: int) -> Column:
    """``struct<cx, cy, scale>`` that fits a bounding box into a view of the given pixels."""
    a, b = mercator_unit(bbox["west"], bbox["north"]), mercator_unit(bbox["east"], bbox["south"])
    span = lambda n: F.greatest(F.abs(b[n] - a[n]), F.lit(1e-7))
    return F.struct(
        ((a["x"] + b["x"]) / 2).alias("cx"), ((a["y"] + b["y"]) / 2).alias("cy"),
        (F.greatest(span("x") / width, span("y") / height) * 1.25).alias("scale"),
    )
