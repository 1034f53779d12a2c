"""Geometry as one nested type, and the measures taken on it.

``parts`` is ``array<array<array<struct<lon,lat,alt>>>>``: polygons of rings of positions.
A point is ``[[[p]]]``, a line or point set ``[[[p, ...]]]``, a line set ``[[line, ...]]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import number_text, strip

POSITION = "struct<lon:double,lat:double,alt:double>"
PARTS_TYPE = f"array<array<array<{POSITION}>>>"


def position(lon, lat, alt=None) -> Column:
    alt = F.lit(None) if alt is None else alt
    return F.struct(
        lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), alt.cast("double").alias("alt")
    )


def positions(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def vertex_count(parts: Column) -> Column:
    return F.coalesce(F.size(positions(parts)), F.lit(0))


def bbox(parts: Column) -> Column:
    """``struct<west, south, east, north>``, null without positions."""
    lons = F.transform(positions(parts), lambda p: p["lon"])
    lats = F.transform(positions(parts), lambda p: p["lat"])
    box = F.struct(
        F.array_min(lons).alias("west"), F.array_min(lats).alias("south"),
        F.array_max(lons).alias("east"), F.array_max(lats).alias("north"),
    )
    return F.when(vertex_count(parts) > 0, box)


def plausible(lon: Column, lat: Column) -> Column:
    return F.coalesce(
        ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)
    )


def keep_plausible(ring: Column) -> Column:
    return F.filter(ring, lambda p: plausible(p["lon"], p["lat"]))


def all_plausible(parts: Column) -> Column:
    return F.forall(positions(parts), lambda p: plausible(p["lon"], p["lat"]))


def close_ring(ring: Column) -> Column:
    """Ring with its first position repeated at the end when missing; null under four positions."""
    first, last = F.get(ring, 0), F.try_element_at(ring, F.lit(-1))
    closed = (first["lon"] == last["lon"]) & (first["lat"] == last["lat"])
    return F.when(F.size(ring) >= 4, F.when(closed, ring).otherwise(F.array_append(ring, first)))


def ring_area(ring: Column) -> Column:
    """Spherical-excess area of a closed ring in square metres."""
    n = F.size(ring)
    steps = F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))),
    )
    total = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)
    return F.when(n < 4, 0.0).otherwise(F.abs(total * K.EARTH_RADIUS * K.EARTH_RADIUS / 2))


def _polygon_area(rings: Column) -> Column:
    holes = F.aggregate(
        F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda acc, r: acc + ring_area(r)
    )
    return F.when(F.size(rings) == 0, 0.0).otherwise(ring_area(F.get(rings, 0)) - holes)


def geometry_area(kind: Column, parts: Column) -> Column:
    """Area of polygons less their holes; null for anything else."""
    total = F.aggregate(parts, F.lit(0.0), lambda acc, rings: acc + _polygon_area(rings))
    return (
        F.when((kind == "Polygon") & (F.size(F.get(parts, 0)) > 0), F.greatest(total, F.lit(0.0)))
        .when((kind == "MultiPolygon") & (total > 0), total)
    )


def drawable_rings(parts: Column) -> Column:
    """Every line or ring of a geometry as a flat list."""
    return F.flatten(parts)


def is_exportable(confidence: Column, parts: Column) -> Column:
    return (confidence != "unverified") & (vertex_count(parts) > 0)


def _number(text: Column) -> Column:
    """A coordinate as JavaScript-style numeric text reads it; empty text is zero."""
    bare = strip(text)
    valid = bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(bare == "", 0.0).when(valid, bare.try_cast("double"))


def kml_positions(text: Column) -> Column:
    """``struct<positions, decimals>`` of a KML coordinate block."""
    tokens = F.filter(
        F.transform(F.split(strip(text), r"\s+"), lambda t: F.split(t, ",")), lambda t: F.size(t) >= 2
    )
    read = F.filter(
        F.transform(
            tokens,
            lambda t: F.struct(
                _number(F.get(t, 0)).alias("lon"), _number(F.get(t, 1)).alias("lat"), _number(F.get(t, 2)).alias("alt"),
                F.greatest(
                    *[F.least(F.length(F.regexp_extract(F.get(t, i), r"\.(\d+)", 1)), F.lit(9)) for i in (0, 1)]
                ).alias("dec"),
            ),
        ),
        lambda p: p["lon"].isNotNull() & p["lat"].isNotNull(),
    )
    decimals = F.array_max(F.transform(read, lambda p: p["dec"]))
    return F.struct(
        F.transform(read, lambda p: position(p["lon"], p["lat"], p["alt"])).alias("positions"),
        F.coalesce(F.nullif(decimals, F.lit(0)), F.lit(6)).alias("decimals"),
    )


def position_text(p: Column) -> Column:
    """``lon,lat[,alt]`` as KML writes it."""
    lonlat = F.concat(number_text(p["lon"]), F.lit(","), number_text(p["lat"]))
    return F.when(p["alt"].isNull(), lonlat).otherwise(F.concat(lonlat, F.lit(","), number_text(p["alt"])))
