"""KML and GeoJSON text of features, composed as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C, geometry as G
from ..functions.stages import stage
from ..functions.text import escape_xml, kml_filename, number_text
from .sequences import in_order, neighbours

NOTE = (
    "Generated from geometry published by the source website. Boundaries reproduce the source data and are not a legal "
    "land-survey record unless the authoritative source establishes that status."
)
DISCLAIMER = (
    "This boundary reproduces the geometry published by the source website. It is\n"
    "not a legal land-survey document unless the authoritative source states that."
)
IMAGE_ONLY_NOTE = "map image only, no coordinates published"
UNVERIFIED_NOTE = "geometry could not be verified"


def _lines(positions: Column, indent: str) -> Column:
    return F.array_join(F.transform(positions, lambda p: F.concat(F.lit(indent), G.position_text(p))), "\n")


def _wrap(tag: str, indent: str, body: Column) -> Column:
    return F.concat(F.lit(f"{indent}<{tag}>\n"), body, F.lit(f"\n{indent}</{tag}>"))


def _coordinates(positions: Column, indent: str) -> Column:
    return _wrap("coordinates", indent, _lines(positions, indent + "  "))


def _polygon(rings: Column, indent: str) -> Column:
    def ring(r: Column, i: Column) -> Column:
        inner = _wrap("LinearRing", indent + "    ", _coordinates(r, indent + "      "))
        return F.when(i == 0, _wrap("outerBoundaryIs", indent + "  ", inner)).otherwise(_wrap("innerBoundaryIs", indent + "  ", inner))

    return _wrap("Polygon", indent, F.array_join(F.transform(rings, ring), "\n"))


def _point(p: Column, indent: str) -> Column:
    return _wrap("Point", indent, F.concat(F.lit(f"{indent}  <coordinates>"), G.position_text(p), F.lit("</coordinates>")))


def geometry_xml(kind: Column, parts: Column, indent: str = "      ") -> Column:
    """Geometry element for any of the six types."""
    deep = indent + "  "
    joined = lambda items, make: F.array_join(F.transform(items, make), "\n")
    many = lambda items, make: _wrap("MultiGeometry", indent, joined(items, make))
    line = lambda r, at: _wrap("LineString", at, _coordinates(r, at + "  "))
    rings = F.flatten(parts)
    return (
        F.when(kind == "Point", _point(F.get(G.positions(parts), 0), indent))
        .when(kind == "MultiPoint", many(G.positions(parts), lambda p: _point(p, deep)))
        .when(kind == "LineString", line(F.get(rings, 0), indent))
        .when(kind == "MultiLineString", many(rings, lambda r: line(r, deep)))
        .when(kind == "Polygon", _polygon(F.get(parts, 0), indent))
        .when(kind == "MultiPolygon", many(parts, lambda rs: _polygon(rs, deep)))
    )


def _description(website: Column, retrieved: Column) -> Column:
    given = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {label}: "), c))
    attributes = F.transform("entries", lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"]))
    system = F.concat(
        F.lit("  Coordinate system: "), F.col("source_crs"), F.when(F.col("transformed"), f" transformed to {C.WGS84}").otherwise("")
    )
    lines = F.concat(
        F.array(F.col("description")),
        F.when(F.size("entries") > 0, F.concat(F.array(F.lit(""), F.lit("Attributes from the source:")), attributes)).otherwise(
            F.array().cast("array<string>")
        ),
        F.array(
            F.lit(""), F.lit("Source"), given("Website", website), given("Source page", F.col("source_page")),
            given("Geometry source", F.col("geometry_source")), given("Map image", F.col("image_source")), system,
            given("Retrieved", retrieved), F.lit(""), F.lit(DISCLAIMER),
        ),
    )
    return F.concat(F.lit("      <description><![CDATA[\n"), F.array_join(F.array_compact(lines), "\n"), F.lit("\n      ]]></description>"))


def placemarks(features: DataFrame, website: str | None = None, retrieved: str | None = None) -> DataFrame:
    """Add ``placemark`` XML to exportable features; the others are left out.

    Expects name, description, geometry_type, parts, entries, source_crs, transformed and
    confidence, and optionally source_page, geometry_source and image_source.
    """
    df = features.filter(G.is_exportable(F.col("confidence"), F.col("parts")))
    for optional in ("source_page", "geometry_source", "image_source"):
        if optional not in df.columns:
            df = df.withColumn(optional, F.lit(None).cast("string"))
    data = F.transform(
        "entries",
        lambda e: F.concat(
            F.lit('        <Data name="'), escape_xml(e["key"]), F.lit('"><value>'), escape_xml(e["value"]), F.lit("</value></Data>")
        ),
    )
    extended = F.when(F.size("entries") > 0, _wrap("ExtendedData", "      ", F.array_join(data, "\n")))
    name = F.coalesce("name", F.lit("Unnamed feature"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("      <name>"), escape_xml(name), F.lit("</name>")),
        _description(F.lit(website).cast("string"), F.lit(retrieved).cast("string")), extended,
        geometry_xml(F.col("geometry_type"), F.col("parts")),
    )
    return stage(df, placemark=_wrap("Placemark", "    ", body))


def _head(name: Column, note: str | None = None) -> Column:
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>'),
        escape_xml(name), F.lit("</name>\n"), F.lit(f"    <description><![CDATA[{note}]]></description>\n" if note else ""),
    )


_FOOT = "\n  </Document>\n</kml>"


def document(name: Column, body: Column, note: str | None = None) -> Column:
    """A whole KML document around ``body``."""
    return F.concat(_head(name, note), body, F.lit(_FOOT + "\n"))


def single_documents(features: DataFrame, website: str | None = None, retrieved: str | None = None) -> DataFrame:
    """One KML document per exportable feature, with its file name."""
    df = placemarks(features, website, retrieved)
    title = F.coalesce("name", F.lit("Feature"))
    return df.withColumn("kml", document(title, F.col("placemark"))).withColumn("file_name", kml_filename(F.col("name"), F.lit("feature")))


def combined_lines(placed: DataFrame, document_key: str) -> DataFrame:
    """Fragments of combined documents: placemarks in trail order inside opened and closed folders.

    ``placed`` has the document key, ``trail`` (folder names, outermost first), ``ord`` and
    ``placemark``. Each fragment opens and closes only the folders that differ from its
    neighbours, so fragments concatenate to a document without ever being collected. Placemarks lie in range partitions, also
    those of one document; the neighbours across an edge come from a table of the partitions' first and last trails.
    Rows keep ``_part`` and ``_row``, which ascend along each document; ``_previous_trail`` and ``_next_trail`` are null at its ends.
    """
    empty = F.array().cast("array<string>")
    ordered = in_order(placed.withColumn("trail", F.coalesce("trail", empty)), [document_key], "trail", "ord")
    df = neighbours(ordered, [document_key], "trail", "_previous_trail", "_next_trail")
    prev, following = F.coalesce("_previous_trail", empty), F.coalesce("_next_trail", empty)

    def shared(other: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.greatest(F.size("trail"), F.lit(1))), lambda n: F.slice("trail", F.lit(1), n) == F.slice(other, F.lit(1), n))
        limit = F.least(F.size("trail"), F.size(other))
        return F.least(limit, F.size(F.filter(same, lambda x: x)))

    opened = F.transform(
        F.slice("trail", shared(prev) + 1, F.size("trail")),
        lambda s: F.concat(F.lit("    <Folder>\n      <name>"), escape_xml(s), F.lit("</name>\n")),
    )
    closed = F.array_repeat(F.lit("\n    </Folder>"), F.size("trail") - shared(following))
    return df.withColumn("fragment", F.concat(F.array_join(opened, ""), F.col("placemark"), F.array_join(closed, "")))


def combined_documents(placed: DataFrame, document_key: str, name: Column) -> DataFrame:
    """Whole combined documents as one text each, for documents that fit in a value; others are written by :func:`write_combined`."""
    parts = combined_lines(placed, document_key).groupBy(document_key).agg(
        F.array_sort(F.collect_list(F.struct("_row", "fragment"))).alias("fragments"), F.min(name).alias("_name")
    )
    body = F.array_join(F.transform("fragments", lambda f: f["fragment"]), "\n")
    return parts.select(document_key, F.size("fragments").alias("records"), document(F.col("_name"), body, NOTE).alias("kml"))


def write_combined(placed: DataFrame, document_key: str, name: Column, path: str) -> None:
    """Combined documents of any size as text files under ``path/document_key=.../``.

    A document's files, one behind the other in the order of their names, are its text, byte for byte that of
    :func:`combined_documents`. Each task writes its stretch of the documents, so none is held by a task. A document needs its
    ``name`` in its first row only.
    """
    lines = combined_lines(placed, document_key)
    first, last = F.col("_previous_trail").isNull(), F.col("_next_trail").isNull()
    value = F.concat(F.when(first, _head(name, NOTE)).otherwise(""), F.col("fragment"), F.when(last, _FOOT).otherwise(""))
    # the stretch of a partition stays in one task and in order: its files are named after the partition
    stretches = lines.select(document_key, value.alias("value"), "_part", "_row").repartitionByRange("_part", "_row").sortWithinPartitions(document_key, "_row")
    stretches.select(document_key, "value").write.mode("overwrite").partitionBy(document_key).text(path)


def skip_reason(availability: Column) -> Column:
    return F.when(availability == "image-only", IMAGE_ONLY_NOTE).otherwise(UNVERIFIED_NOTE)


def export_split(parcels: DataFrame) -> DataFrame:
    """Parcels that can be written as KML and those skipped, with the reason."""
    label = F.coalesce("reference", "name")
    return parcels.withColumn("exported", F.col("kml_available")).withColumn(
        "skip_line",
        F.when(
            ~F.col("kml_available"),
            F.concat(label, F.lit(" - "), skip_reason(F.col("geometry_availability")), F.lit(" ("), F.col("source_page"), F.lit(")")),
        ),
    )


def _position_json(p: Column) -> Column:
    alt = F.when(p["alt"].isNotNull(), F.concat(F.lit(","), number_text(p["alt"]))).otherwise("")
    return F.concat(F.lit("["), number_text(p["lon"]), F.lit(","), number_text(p["lat"]), alt, F.lit("]"))


def geometry_json(kind: Column, parts: Column) -> Column:
    """GeoJSON geometry text."""
    listed = lambda items, make: F.concat(F.lit("["), F.array_join(F.transform(items, make), ","), F.lit("]"))
    line = lambda r: listed(r, _position_json)
    rings = lambda rs: listed(rs, line)
    coordinates = (
        F.when(kind == "Point", _position_json(F.get(G.positions(parts), 0)))
        .when(kind.isin("LineString", "MultiPoint"), line(G.positions(parts)))
        .when(kind.isin("Polygon", "MultiLineString"), rings(F.flatten(parts)))
        .otherwise(listed(parts, rings))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))
