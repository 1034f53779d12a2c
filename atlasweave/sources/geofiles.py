"""Geographic file bodies (KML, KMZ, GPX, GeoJSON) as feature, overlay and document tables.

XML bodies are opened in an Arrow-batched pass that only locates elements and hands their
text on; coordinates, validity, ring closing and geometry precedence are column expressions.
GeoJSON is read natively.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.entities import html5
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import crs as C, geometry as G
from ..functions.stages import stage
from ..functions.text import number_text, strip
from ..functions.urls import short_id

ENTRIES = "array<struct<key:string,value:string>>"
RAW_SCHEMA = (
    "asset_id string, url string, kind string, idx int, name string, description string, "
    f"entries {ENTRIES}, folder_path array<string>, polygons array<array<string>>, lines array<string>, "
    "points array<string>, href string, north string, south string, east string, west string, rotation string, warning string"
)
_RAW = (
    "asset_id url kind idx name description entries folder_path polygons lines points href north south east west "
    "rotation warning"
).split()
FEATURE_COLUMNS = [
    "asset_id", "url", "feature_id", "idx", "name", "description", "geometry_type", "parts", "entries", "source_crs",
    "transformed", "confidence", "folder_path",
]


class _Element:
    __slots__ = ("tag", "attrs", "parent", "children", "pieces")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children, self.pieces = tag, attrs, parent, [], []

    def find_all(self, *path: str) -> Iterator[_Element]:
        """Descendants reached through ``path``, each step at any depth, in document order."""
        for child in self.children:
            if child.tag == path[0]:
                if len(path) == 1:
                    yield child
                else:
                    yield from child.find_all(*path[1:])
                    continue
            yield from child.find_all(*path)

    def first(self, *path: str) -> _Element | None:
        return next(self.find_all(*path), None)

    def child(self, tag: str) -> _Element | None:
        return next((c for c in self.children if c.tag == tag), None)

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.pieces)


_REFERENCE = re.compile(r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|&(#\d+;|#[xX][0-9a-fA-F]+;|(?:amp|lt|gt|quot|apos);)?(?:([A-Za-z][A-Za-z0-9]*);)?", re.S)


def _readable(xml: str) -> str:
    """References that an XML parser would stop at, written so that it reads on."""

    def one(found: re.Match) -> str:
        if found[0][0] == "<" or found[1]:
            return found[0]
        known = html5.get(f"{found[2]};") if found[2] else None
        return "".join(f"&#{ord(c)};" for c in known) if known else "&amp;" + found[0][1:]

    return _REFERENCE.sub(one, xml.lstrip("\ufeff"))


def _tree(xml: str) -> _Element:
    """Element tree of an XML text; a text that breaks off gives the elements before the fault.

    The text is decoded already, so its own encoding declaration does not count; named characters
    that XML does not define are read as in HTML, and an ampersand that begins no reference is one.
    """
    root = _Element("", {}, None)
    stack = [root]

    def start(tag, attrs):
        node = _Element(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        stack[-1].pieces.append(node)
        stack.append(node)

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].pieces.append(data)
    try:
        parser.Parse(_readable(xml).encode("utf-8"), True)
    except expat.ExpatError:
        pass
    return root


def _label(node: _Element | None) -> str | None:
    return (" ".join(node.text().split()) or None) if node is not None else None


def _row(**known) -> tuple:
    return tuple(known.get(c) for c in _RAW)


def _folders(node: _Element) -> list[str]:
    names = []
    up = node.parent
    while up is not None:
        if up.tag.lower() == "folder" and _label(up.child("name")):
            names.append(_label(up.child("name")))
        up = up.parent
    return names[::-1]


def _kml_rows(xml: str, asset_id: str, url: str) -> Iterator[tuple]:
    root = _tree(xml)
    same = dict(asset_id=asset_id, url=url)
    titles = (_label(parent.child("name")) for tag in ("Document", "kml") for parent in root.find_all(tag) if parent.child("name"))
    yield _row(**same, kind="document", name=next(titles, None))
    for i, mark in enumerate(root.find_all("Placemark")):
        values = {}
        for data in mark.find_all("ExtendedData", "Data"):
            values[data.attrs.get("name")] = _label(data.child("value")) or values.get(data.attrs.get("name"))
        for data in mark.find_all("ExtendedData", "SimpleData"):
            values[data.attrs.get("name")] = _label(data) or values.get(data.attrs.get("name"))
        polygons = [
            [r.text() for r in [polygon.first("outerBoundaryIs", "LinearRing", "coordinates")] if r is not None]
            + [r.text() for r in polygon.find_all("innerBoundaryIs", "LinearRing", "coordinates")]
            for polygon in mark.find_all("Polygon")
        ]
        yield _row(
            **same, kind="placemark", idx=i, name=_label(mark.child("name")), description=_label(mark.child("description")),
            entries=[{"key": k, "value": v} for k, v in values.items() if k and v], folder_path=_folders(mark), polygons=polygons,
            lines=[x.text() for x in mark.find_all("LineString", "coordinates")],
            points=[x.text() for x in mark.find_all("Point", "coordinates")],
        )
    for i, overlay in enumerate(root.find_all("GroundOverlay")):
        box = overlay.first("LatLonBox")
        icon = next((icon.child("href") for icon in overlay.find_all("Icon") if icon.child("href")), None)
        if box is not None and _label(icon):
            sides = {side: _label(box.child(side)) for side in ("north", "south", "east", "west", "rotation")}
            yield _row(**same, kind="overlay", idx=i, name=_label(overlay.child("name")), href=_label(icon), **sides)


def _gpx_rows(xml: str, asset_id: str, url: str) -> Iterator[tuple]:
    root = _tree(xml)
    same = dict(asset_id=asset_id, url=url)
    at = lambda p: f"{p.attrs.get('lon', 'none')},{p.attrs.get('lat', 'none')}"
    gpx = root.child("gpx")
    meta = gpx.child("metadata") if gpx is not None else None
    yield _row(**same, kind="document", name=_label(meta.child("name")) if meta is not None else None)
    for i, point in enumerate(root.find_all("wpt")):
        yield _row(**same, kind="wpt", idx=i, name=_label(point.child("name")), description=_label(point.child("desc")), points=[at(point)])
    tracks = [n for n in _walk(root) if n.tag in ("trk", "rte")]
    for i, track in enumerate(tracks):
        path = " ".join(at(n) for n in _walk(track) if n.tag in ("trkpt", "rtept"))
        yield _row(**same, kind="trk", idx=i, name=_label(track.child("name")), description=_label(track.child("desc")), lines=[path])


def _walk(node: _Element) -> Iterator[_Element]:
    for child in node.children:
        yield child
        yield from _walk(child)


def _kmz_rows(body: bytes, asset_id: str, url: str) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as archive:
            infos = archive.infolist()
            named = [i for i in infos if i.filename.lower() == "doc.kml"] or [i for i in infos if i.filename.lower().endswith(".kml")]
            if not named:
                yield _row(asset_id=asset_id, url=url, kind="document", warning=K.KMZ_NO_KML_WARNING)
                return
            xml = archive.read(named[0]).decode("utf-8", "replace")
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError):
        yield _row(asset_id=asset_id, url=url, kind="document", warning=K.KMZ_UNREADABLE_WARNING)
        return
    for row in _kml_rows(xml, asset_id, f"{url}!{named[0].filename}"):
        if row[_RAW.index("kind")] == "document" and row[_RAW.index("name")] is None:
            row = tuple(named[0].filename if c == "name" else v for c, v in zip(_RAW, row))
        yield row


def xml_rows(bodies: DataFrame) -> DataFrame:
    """Document, placemark, way point, track and overlay rows of KML, KMZ and GPX bodies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for asset_id, url, fmt, body in zip(batch["asset_id"], batch["url"], batch["format"], batch["body"]):
                data = bytes(body or b"")
                if fmt == "kmz":
                    rows.extend(_kmz_rows(data, asset_id, url))
                else:
                    xml = data.decode("utf-8", "replace").lstrip("﻿")
                    rows.extend((_kml_rows if fmt == "kml" else _gpx_rows)(xml, asset_id, url))
            yield pd.DataFrame(rows, columns=_RAW)

    wanted = bodies.filter(F.col("format").isin("kml", "kmz", "gpx")).select("asset_id", "url", "format", "body")
    return wanted.mapInPandas(read, RAW_SCHEMA)


# ------------------------------------------------------------------------------ KML and GPX


def _shape_xml(raw: DataFrame) -> DataFrame:
    """Usable geometry of each placemark, way point or track: polygons first, then lines, then points."""
    read = lambda t: G.kml_positions(t)["positions"]
    empty = F.array().cast(f"array<array<{G.POSITION}>>")
    df = raw.filter(F.col("kind").isin("placemark", "wpt", "trk"))
    df = stage(
        df,
        _rings=F.transform("polygons", lambda rings: F.transform(rings, read)),
        _lines=F.coalesce(F.transform("lines", read), empty),
        _points=F.coalesce(F.transform("points", read), empty),
    )
    df = stage(
        df,
        _polygons=F.filter(
            F.transform(
                "_rings", lambda rings: F.filter(F.transform(rings, lambda r: G.close_ring(G.keep_plausible(r))), lambda r: r.isNotNull())
            ),
            lambda rings: F.size(rings) > 0,
        ),
        _good_lines=F.filter(F.transform("_lines", G.keep_plausible), lambda r: F.size(r) >= 2),
        _good_points=F.filter(F.transform("_points", lambda r: F.get(G.keep_plausible(r), 0)), lambda p: p.isNotNull()),
    )
    n_poly, n_line, n_point = (F.coalesce(F.size(c), F.lit(0)) for c in ("_polygons", "_good_lines", "_good_points"))
    kind = F.when(n_poly > 0, "Polygon").when(n_line > 0, "LineString").when(n_point > 0, "Point")
    count = F.when(n_poly > 0, n_poly).when(n_line > 0, n_line).otherwise(n_point)
    parts = (
        F.when(n_poly > 0, F.col("_polygons"))
        .when(n_line > 0, F.array(F.col("_good_lines")))
        .when(n_point > 0, F.array(F.array(F.col("_good_points"))))
    )
    code = F.when(n_poly > 0, "poly").when(n_line > 0, "line").otherwise("point")
    seed = F.when(F.col("kind") == "placemark", F.concat(F.when(count > 1, "multi").otherwise(""), code)).otherwise(F.col("kind"))
    lost = lambda blocks: F.size(F.filter(blocks, lambda r: F.size(G.keep_plausible(r)) < F.size(r)))
    # Only the blocks that were looked at can have dropped positions.
    dropped = (
        F.coalesce(lost(F.flatten("_rings")), F.lit(0))
        + F.when(n_poly == 0, lost(F.col("_lines"))).otherwise(0)
        + F.when((n_poly == 0) & (n_line == 0), lost(F.col("_points"))).otherwise(0)
    )
    df = stage(
        df,
        geometry_type=F.concat(F.when(count > 1, "Multi").otherwise(""), kind),
        parts=parts,
        _seed=F.concat(F.col("url"), F.lit("#"), seed, F.col("idx").cast("string")),
        dropped=F.when(F.col("kind") == "placemark", dropped).otherwise(0),
    )
    return df.select(
        "asset_id", "url", short_id("feat", F.col("_seed")).alias("feature_id"),
        (F.col("idx") + F.when(F.col("kind") == "trk", 1_000_000).otherwise(0)).alias("idx"), "name", "description",
        "geometry_type", "parts", F.coalesce("entries", F.array().cast(ENTRIES)).alias("entries"),
        F.lit(C.WGS84).alias("source_crs"), F.lit(False).alias("transformed"), F.lit("source").alias("confidence"),
        F.coalesce("folder_path", F.array().cast("array<string>")).alias("folder_path"), "dropped",
    )


def xml_features(raw: DataFrame) -> DataFrame:
    """Features of :func:`xml_rows` output."""
    return _shape_xml(raw).filter("geometry_type is not null").select(*FEATURE_COLUMNS)


def kml_overlays(raw: DataFrame) -> DataFrame:
    """Ground overlays with a link and complete, plausible bounds."""
    n = lambda c: F.col(c).try_cast("double")
    df = raw.filter("kind = 'overlay'")
    df = stage(df, **{f"{c}_n": n(c) for c in ("north", "south", "east", "west", "rotation")})
    ok = G.plausible(F.col("west_n"), F.col("south_n")) & G.plausible(F.col("east_n"), F.col("north_n"))
    return df.filter(ok).select(
        "asset_id", "url", short_id("feat", F.concat("url", F.lit("#overlay"), F.col("idx").cast("string"))).alias("overlay_id"),
        "idx", "name", "href", *[F.col(f"{c}_n").alias(c) for c in ("north", "south", "east", "west", "rotation")],
    )


# ---------------------------------------------------------------------------------- GeoJSON

_GEOMETRY = "struct<type:string,coordinates:variant>"
_GEOJSON = (
    "struct<type:string,id:string,crs:struct<properties:struct<name:string,href:string>>,"
    f"features:array<struct<type:string,id:string,geometry:{_GEOMETRY},properties:map<string,variant>,coordinates:variant>>,"
    f"geometry:{_GEOMETRY},properties:map<string,variant>,coordinates:variant>"
)


def _property_entries(properties: Column) -> Column:
    """Scalar properties as text, in source order; nested and null ones are left out."""
    kind = lambda v: F.schema_of_variant(v)
    number = lambda v: number_text(F.try_variant_get(v, "$", "double"))
    scalars = F.filter(
        F.map_entries(properties),
        lambda e: e["value"].isNotNull() & ~kind(e["value"]).rlike("^(OBJECT|ARRAY|VOID)"),
    )
    return F.transform(
        scalars,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(kind(e["value"]).isin("STRING", "BOOLEAN"), F.try_variant_get(e["value"], "$", "string"))
            .otherwise(number(e["value"])).alias("value"),
        ),
    )


def _pick(entries: Column, keys: list[str]) -> Column:
    """First non-blank property among ``keys``, trimmed."""
    value = lambda k: F.nullif(strip(F.get(F.filter(entries, lambda e: e["key"] == k), 0)["value"]), F.lit(""))
    return F.coalesce(*[value(k) for k in keys])


def _coordinates(kind: Column, coordinates: Column) -> Column:
    """Coordinates of any of the six types as parts of ``[x, y, z]`` arrays; null when misshapen."""
    read = lambda depth: F.try_variant_get(coordinates, "$", "array<" * depth + "double" + ">" * depth)
    return (
        F.when(kind == "Point", F.when(F.size(read(1)) == 0, F.array().cast("array<array<array<array<double>>>>")).otherwise(F.array(F.array(F.array(read(1))))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(read(2))))
        .when(kind.isin("Polygon", "MultiLineString"), F.array(read(3)))
        .when(kind == "MultiPolygon", read(4))
    )


def _geojson_nodes(bodies: DataFrame) -> DataFrame:
    df = bodies.filter(F.col("format").isin("geojson", "topojson"))
    text = F.decode("body", "UTF-8") if dict(bodies.dtypes)["body"] == "binary" else F.col("body")
    df = stage(df, _text=text)
    df = stage(df, _v=F.try_parse_json("_text"))
    df = stage(df, _doc=F.when(F.col("_v").isNotNull(), F.from_json("_text", _GEOJSON)))
    declared = F.coalesce("_doc.crs.properties.name", "_doc.crs.properties.href")
    alone = F.array(F.struct(*[F.col(f"_doc.{c}").alias(c) for c in ("type", "id", "geometry", "properties", "coordinates")]))
    single = (F.col("_doc.type") == "Feature") | F.col("_doc.geometry").isNotNull() | F.col("_doc.coordinates").isNotNull()
    return stage(
        df.drop("body"), valid=F.col("_v").isNotNull(), declared=declared, source_crs=C.crs_code(declared),
        nodes=F.when(F.col("_doc.features").isNotNull(), F.col("_doc.features")).when(single, alone),
    ).drop("_text", "_v", "_doc")


def _geojson_shapes(bodies: DataFrame) -> DataFrame:
    df = _geojson_nodes(bodies).select("asset_id", "url", "source_crs", "declared", F.posexplode("nodes").alias("idx", "n"))
    bare = F.struct(F.col("n.type").alias("type"), F.col("n.coordinates").alias("coordinates"))
    df = stage(df, _g=F.coalesce(F.col("n.geometry"), F.when(F.col("n.coordinates").isNotNull(), bare)))
    df = stage(df, geometry_type=F.col("_g.type"), _xyz=_coordinates(F.col("_g.type"), F.col("_g.coordinates")), entries=_property_entries(F.col("n.properties")))
    df = df.filter(F.col("geometry_type").isin(*K.GEOMETRY_TYPES) & F.col("_xyz").isNotNull())
    code = F.col("source_crs")
    support = C.crs_support(code)

    def convert(p: Column) -> Column:
        at = C.to_wgs84(p[0], p[1], code)
        rounded = lambda v: F.when(code == C.WGS84, v).otherwise(F.round(v, 7))
        return F.when(at.isNotNull(), F.struct(rounded(at["lon"]).alias("lon"), rounded(at["lat"]).alias("lat"), F.get(p, 2).alias("alt")))

    parts = F.transform("_xyz", lambda rings: F.transform(rings, lambda ring: F.transform(ring, convert)))
    df = stage(df, parts=parts.cast(G.PARTS_TYPE), _support=support)
    readable = F.forall(G.positions(F.col("parts")), lambda p: p.isNotNull())
    inside = (code != C.WGS84) | G.all_plausible(F.col("parts"))
    return stage(df, _readable=readable, _inside=F.coalesce(inside, F.lit(False)))


def geojson_features(bodies: DataFrame) -> DataFrame:
    """Features of GeoJSON bodies; one bad or unconvertible position drops its whole feature."""
    df = _geojson_shapes(bodies).filter("_readable and _inside")
    entries = F.coalesce("entries", F.array().cast(ENTRIES))
    moved = (F.col("source_crs") != C.WGS84) & (F.size(G.positions(F.col("parts"))) > 0)
    seed = F.concat("url", F.lit("#"), F.coalesce(F.col("n.id"), F.col("idx").cast("string")))
    df = stage(df, entries=entries, transformed=moved, _seed=seed)
    out = df.select(
        "asset_id", "url", short_id("feat", F.col("_seed")).alias("feature_id"), "idx",
        _pick(F.col("entries"), K.GEOJSON_NAME_KEYS).alias("name"), _pick(F.col("entries"), K.GEOJSON_DESCRIPTION_KEYS).alias("description"),
        "geometry_type", "parts", "entries", "source_crs", "transformed",
        F.when(F.col("transformed"), "source-transformed").otherwise("source").alias("confidence"),
        F.array().cast("array<string>").alias("folder_path"),
    )
    return out.select(*FEATURE_COLUMNS)


# -------------------------------------------------------------------------------- documents


def geo_features(bodies: DataFrame) -> DataFrame:
    """Features of all readable formats."""
    return xml_features(xml_rows(bodies)).unionByName(geojson_features(bodies))


def geo_documents(bodies: DataFrame) -> DataFrame:
    """One row per body: document name, reference system, feature count and warnings.

    Formats that cannot be read give no features and a warning that says so.
    """
    raw = xml_rows(bodies)
    names = raw.filter("kind = 'document'").select("asset_id", F.col("name").alias("document_name"), "warning")
    lost = _shape_xml(raw).groupBy("asset_id").agg(F.sum("dropped").alias("dropped"))
    xml = names.join(lost, "asset_id", "left").select(
        "asset_id", "document_name", F.lit(C.WGS84).alias("source_crs"),
        F.concat(
            F.array_compact(F.array("warning")),
            F.array_repeat(F.lit(K.OUT_OF_RANGE_WARNING), F.coalesce("dropped", F.lit(0)).cast("int")),
        ).alias("warnings"),
    )
    shapes = _geojson_shapes(bodies).groupBy("asset_id").agg(F.count_if(F.col("_readable") & ~F.col("_inside")).alias("outside"))
    nodes = _geojson_nodes(bodies).select("asset_id", "valid", "declared", "source_crs")
    reason = C.crs_support(F.col("source_crs"))["reason"]
    geojson = nodes.join(shapes, "asset_id", "left").select(
        "asset_id", F.lit(None).cast("string").alias("document_name"),
        F.when(F.col("valid"), F.col("source_crs")).otherwise(C.WGS84).alias("source_crs"),
        F.when(~F.col("valid"), F.array(F.lit(K.BAD_JSON_WARNING))).otherwise(
            F.concat(
                F.array_compact(F.array(F.when(F.col("declared").isNotNull(), reason))),
                F.array_repeat(F.lit(K.OUT_OF_RANGE_WARNING), F.coalesce("outside", F.lit(0)).cast("int")),
            )
        ).alias("warnings"),
    )
    unread = bodies.filter(~F.col("format").isin("kml", "kmz", "gpx", "geojson", "topojson")).select(
        "asset_id", F.lit(None).cast("string").alias("document_name"), F.lit(C.WGS84).alias("source_crs"),
        F.array(F.concat(F.upper("format"), F.lit(" geometry cannot be read by this tool yet."))).alias("warnings"),
    )
    documents = xml.unionByName(geojson).unionByName(unread)
    counts = geo_features(bodies).groupBy("asset_id").agg(F.count(F.lit(1)).alias("feature_count"))
    known = bodies.select("asset_id", "url", "format").join(documents, "asset_id").join(counts, "asset_id", "left")
    return known.withColumn("feature_count", F.coalesce("feature_count", F.lit(0)))

