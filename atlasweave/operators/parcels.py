"""Maps and land parcels from features and map imagery, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G, land, urls as U
from ..functions.ordering import number_rows
from ..functions.stages import stage
from ..functions.text import kml_filename, safe_segment
from ..functions.labels import saved_extension
from ..session import written
from .places import location_steps, url_steps, with_location

BBOX = ["west", "south", "east", "north"]


def with_area(features: DataFrame) -> DataFrame:
    """Add ``area_square_metres`` (stated, else computed from exportable geometry) and its basis."""
    exportable = G.is_exportable(F.col("confidence"), F.col("parts"))
    df = stage(
        features,
        _stated=land.stated_area(F.col("entries")),
        _computed=F.when(exportable, G.geometry_area(F.col("geometry_type"), F.col("parts"))),
    )
    basis = F.when(F.col("_stated").isNotNull(), "source-attribute").when(F.col("_computed").isNotNull(), "computed-from-geometry")
    return df.withColumn("area_basis", basis).withColumn("area_square_metres", F.coalesce("_stated", "_computed")).drop("_stated", "_computed")


def parcels(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One parcel per feature, with all columns or only those asked for: what is not asked for is not derived.

    Expects scan_id, map_url, source_page, document_name, ord (unique order within the scan),
    feature_id, name, entries, folder_path, geometry_type, parts and confidence.
    """
    asked = lambda *names: columns is None or not set(columns).isdisjoint(names)
    df = with_area(features) if asked("area_square_metres", "area_basis") else features
    if asked("nodes", "location_id", "ancestor_ids"):
        df = U.with_url_places(df, "source_page", "_places")
        steps = location_steps(F.col("entries"), F.col("document_name"), F.col("folder_path"), F.col("_places"))
        df = with_location(stage(df, steps=steps)).drop("_places", "steps")
    derived = {"map_id": U.short_id("map", F.col("map_url")), "parcel_id": U.short_id("parcel", F.concat("map_url", F.lit("#"), F.col("feature_id")))}
    if asked("reference", "name"):
        derived["reference"] = land.survey_reference(F.col("name"), F.col("entries"))
    if asked("kml_available", "geometry_availability"):
        derived["kml_available"] = G.is_exportable(F.col("confidence"), F.col("parts"))
    if asked(*BBOX):
        derived["_box"] = G.bbox(F.col("parts"))
    df = stage(df, **derived)
    given = {"geometry_source": F.col("map_url")}
    if asked("name"):
        # Written first: the range partitions of the numbering sample their input, which would read and derive every feature twice.
        kept = df if columns is None else df.select("scan_id", "ord", *[c for c in df.columns if c in [*columns, "name", "reference", "kml_available", "map_url", "_box"] and c not in ("scan_id", "ord")])
        # Only features without a name or reference are named by their number: the others pass the numbering as bare keys.
        kept = written(kept)
        bare = F.col("name").isNull() & F.col("reference").isNull()
        rest = [c for c in kept.columns if c not in ("scan_id", "ord")]
        keys = kept.select("scan_id", "ord", F.when(bare, F.struct(*rest)).alias("_row"))
        numbered = number_rows(keys, ["scan_id"], ["ord"], "_no").filter("_row is not null").select("scan_id", "ord", "_row.*", "_no")
        df = kept.filter(~bare).withColumn("_no", F.lit(None).cast("bigint")).unionByName(numbered)
        given["name"] = F.coalesce("name", "reference", F.concat(F.lit("Feature "), F.col("_no").cast("string")))
    if asked("geometry_availability"):
        given["geometry_availability"] = F.when(F.col("kml_available"), "available").otherwise("unverified")
    if asked(*BBOX):
        given |= {s: F.col(f"_box.{s}") for s in BBOX}
    df = df.withColumns(given).drop("_box", "_no")
    return df if columns is None else df.select(*columns)


def imagery_parcels(images: DataFrame, page_images: DataFrame, geometry_pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records for map-looking images on pages without geometry: the image is the record. All columns, or only those asked for.

    One row per (image, page) of ``page_images``, whose rows are distinct; the page is part of the key, so an image shown on
    two pages does not give two records with one id.
    """
    asked = lambda *names: columns is None or not set(columns).isdisjoint(names)
    label = F.coalesce("alt_text", "filename")
    none = F.array().cast("array<struct<key:string,value:string>>")
    maps = images.filter("category = 'map'").drop("source_page")
    maps = stage(maps, name=label, reference=land.survey_reference(label, none)) if asked("reference") else maps.withColumn("name", label)
    shown = page_images.join(maps.select("asset_id"), "asset_id", "left_semi").join(geometry_pages.select("source_page").distinct(), "source_page", "left_anti")
    df = shown.join(maps, "asset_id")
    if asked("location_id", "ancestor_ids", "nodes"):
        # What a page's URL tells is derived once a page, not once for each of its images.
        pages = U.with_url_places(shown.select("source_page").distinct(), "source_page", "_places")
        df = df.join(with_location(stage(pages, steps=url_steps(F.col("_places")))).drop("_places", "steps"), "source_page")
    df = stage(
        df, map_id=U.short_id("map", F.concat(F.lit("imagery|"), F.col("source_page"))),
        parcel_id=U.short_id("parcel", F.concat(F.lit("imagery|"), F.col("url"), F.lit("|"), F.col("source_page"))),
        geometry_availability=F.lit("image-only"), kml_available=F.lit(False),
    )
    return df if columns is None else df.select(*columns)


def geometry_maps(parcels_: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """One map per geographic file; files without features are listed too.

    ``documents`` has map_url, filename, source_page, geo_format, document_name, source_crs
    and warnings. The location is that of the first parcel, else the one its page URL implies.
    """
    images = links.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("images"))
    per = parcels_.join(images, "parcel_id", "left").groupBy("map_id").agg(
        F.count(F.lit(1)).alias("parcel_count"), F.sum(F.coalesce("images", F.lit(0))).alias("image_count"),
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
        F.min(F.struct("ord", "location_id", "ancestor_ids")).alias("first"),
    )
    docs = documents.withColumn("map_id", U.short_id("map", F.col("map_url")))
    docs = U.with_url_places(docs, "source_page", "_places")
    docs = with_location(stage(docs, steps=url_steps(F.col("_places")))).drop("_places", "steps", "nodes")
    df = docs.join(per, "map_id", "left")
    found = F.col("parcel_count").isNotNull()
    no_features = F.when(F.size("warnings") > 0, F.slice("warnings", 1, 4)).otherwise(F.array(F.lit(K.NO_FEATURES_WARNING)))
    placed = F.col("first.location_id").isNotNull()
    return df.select(
        "map_id", F.when(placed, F.col("first.location_id")).otherwise(F.col("location_id")).alias("location_id"),
        F.when(placed, F.col("first.ancestor_ids")).otherwise(F.col("ancestor_ids")).alias("ancestor_ids"),
        F.when(found, F.coalesce("document_name", "filename")).otherwise(F.col("filename")).alias("name"),
        F.lit("geometry").alias("map_kind"), "source_page", F.col("map_url").alias("source_url"), F.col("geo_format").alias("format"),
        F.coalesce("parcel_count", F.lit(0)).alias("parcel_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"), *BBOX,
        F.when(found, F.col("source_crs")).alias("source_crs"),
        F.when(found, F.slice("warnings", 1, 4)).otherwise(no_features).alias("warnings"),
    )


def imagery_pages(page_images: DataFrame, geometry_pages: DataFrame) -> DataFrame:
    """(map_id, source_page, location_id, ancestor_ids, images) of pages without geometry: how many map-looking images each shows,
    which is how many records :func:`imagery_parcels` gives it. ``page_images`` holds such images only, in distinct rows.

    Images are counted before pages are chosen and placed, so none of them is moved for it.
    """
    counts = page_images.groupBy("source_page").agg(F.count(F.lit(1)).alias("images"))
    pages = counts.join(geometry_pages.select("source_page").distinct(), "source_page", "left_anti")
    pages = U.with_url_places(pages, "source_page", "_places")
    pages = with_location(stage(pages, steps=url_steps(F.col("_places")))).drop("_places", "steps")
    pages = stage(pages, map_id=U.short_id("map", F.concat(F.lit("imagery|"), F.col("source_page"))))
    return pages.select("map_id", "source_page", "location_id", "ancestor_ids", "images")


def imagery_maps(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """One map per page of :func:`imagery_pages`, named by the page title, else its URL."""
    df = pages.withColumnRenamed("images", "parcel_count").join(titles.select(F.col("url").alias("source_page"), "title"), "source_page", "left")
    null = lambda t: F.lit(None).cast(t)
    return df.select(
        "map_id", "location_id", "ancestor_ids", F.coalesce("title", "source_page").alias("name"), F.lit("imagery").alias("map_kind"),
        "source_page", null("string").alias("source_url"), null("string").alias("format"), "parcel_count",
        F.col("parcel_count").alias("image_count"), *[null("double").alias(s) for s in BBOX], null("string").alias("source_crs"),
        F.array().cast("array<string>").alias("warnings"),
    )


PARCEL_COLUMNS = [
    "parcel_id", "map_id", "location_id", "ancestor_ids", "reference", "name", "geometry_availability", "kml_available",
    "area_square_metres", "area_basis", "folder_path", "source_page", "geometry_source",
]


def all_parcels(geometry: DataFrame, imagery: DataFrame) -> DataFrame:
    """Geometry-backed and imagery-only records in one table."""
    return geometry.select([c for c in PARCEL_COLUMNS if c in geometry.columns]).unionByName(
        imagery.select([c for c in PARCEL_COLUMNS if c in imagery.columns]), allowMissingColumns=True
    )


def asset_features(assets: DataFrame, documents: DataFrame, features: DataFrame) -> DataFrame:
    """Geographic assets with their feature count and first four warnings."""
    counts = features.groupBy("asset_id").agg(F.count(F.lit(1)).alias("feature_count"))
    df = assets.join(documents.select("asset_id", "warnings"), "asset_id", "left").join(counts, "asset_id", "left")
    read = F.col("warnings").isNotNull()
    return df.withColumn("feature_count", F.when(read, F.coalesce("feature_count", F.lit(0)))).withColumn(
        "geometry_warnings", F.slice(F.coalesce("warnings", F.array().cast("array<string>")), 1, 4)
    ).drop("warnings")


def merge_bbox(rows: DataFrame, key: str) -> DataFrame:
    """Union of bounding boxes per key; rows without one do not matter."""
    return rows.groupBy(key).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def location_summary(maps: DataFrame, records: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """Dashboard of every place at once: maps, parcels, distinct images, availability, bounds, children.

    Counts are reduced per place before they are exploded to ancestors; images are reduced to
    distinct (place, image) first, since an image counts once per subtree.
    """
    m = maps.filter("location_id is not null").groupBy("location_id", "ancestor_ids").agg(
        F.count(F.lit(1)).alias("maps"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )
    m = m.withColumn("id", F.explode("ancestor_ids")).groupBy("id").agg(
        F.sum("maps").alias("maps"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )
    is_ = lambda s: F.count_if(F.col("geometry_availability") == s)
    p = records.filter("location_id is not null").groupBy("location_id", "ancestor_ids").agg(
        F.count(F.lit(1)).alias("parcels"), F.count_if("kml_available").alias("kml_available"),
        is_("image-only").alias("image_only"), is_("unverified").alias("unverified"),
    )
    p = p.withColumn("id", F.explode("ancestor_ids")).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("parcels", "kml_available", "image_only", "unverified")])
    shown = records.filter("location_id is not null").select("parcel_id", "ancestor_ids", "location_id").join(links.select("parcel_id", "asset_id"), "parcel_id")
    shown = shown.select("location_id", "ancestor_ids", "asset_id").distinct()
    i = shown.select(F.explode("ancestor_ids").alias("id"), "asset_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("images"))
    c = places.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    df = places.select(F.col("location_id").alias("id"), "name")
    for part in (m, p, i, c):
        df = df.join(part, "id", "left")
    counts = ["maps", "parcels", "images", "kml_available", "image_only", "unverified", "children"]
    return df.select(F.col("id").alias("location_id"), "name", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts], *BBOX)


def selection_stats(records: DataFrame, links: DataFrame, group: list[str], imagery: DataFrame | None = None) -> DataFrame:
    """Totals of a selection: with KML, with an image, image-only and unverified.

    Image-only records may come counted, as the ``images`` of each group in ``imagery``: each has an image and no geometry.
    """
    with_image = links.select("parcel_id").distinct().withColumn("_image", F.lit(True))
    df = records.join(with_image, "parcel_id", "left")
    is_ = lambda s: F.count_if(F.col("geometry_availability") == s)
    stats = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("kml_available").alias("with_kml"), F.count("_image").alias("with_image"),
        is_("image-only").alias("image_only"), is_("unverified").alias("unverified"),
    )
    if imagery is None:
        return stats
    n, none = F.col("images"), F.lit(0).cast("bigint")
    counted = imagery.select(*group, n.alias("total"), none.alias("with_kml"), n.alias("with_image"), n.alias("image_only"), none.alias("unverified"))
    names = [c for c in stats.columns if c not in group]
    return stats.unionByName(counted).groupBy(*group).agg(*[F.sum(c).alias(c) for c in names])


def filter_parcels(records: DataFrame, mode: str) -> DataFrame:
    """``all``, ``kml`` (with KML) or ``image`` (without)."""
    return {"all": records, "kml": records.filter("kml_available"), "image": records.filter("not kml_available")}[mode]


def search_parcels(records: DataFrame, query: str, entries: str = "entries", limit: int | None = None) -> DataFrame:
    """Records whose reference, name or property values hold the text, punctuation ignored from 3 characters."""
    needle = query.strip().lower()
    if not needle:
        return records.limit(0)
    values = F.array_join(F.transform(entries, lambda e: e["value"]), " ")
    text = F.lower(F.concat_ws(" ", F.coalesce("reference", F.lit("")), "name", values))
    compact = "".join(c for c in needle if c.isascii() and (c.isalnum() or c == "_"))
    test = text.contains(needle)
    if len(compact) >= 3:
        test = test | F.regexp_replace(text, r"[^\w]", "").contains(compact)
    found = records.filter(test)
    return found if limit is None else found.limit(limit)


def overlay_selection(overlays: DataFrame, records: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """(location_id, overlay) shown for each place: overlays whose link is a georeferenced image
    of its subtree; all overlays where there is none.

    ``links`` carries georeferenced and url, ``overlays`` overlay_id and href. The fall-back is
    kept as one row with a null overlay, meaning "all", so it is never multiplied out.
    """
    hit = links.filter("georeferenced").select("parcel_id", F.col("url").alias("href"))
    hit = hit.join(records.filter("location_id is not null").select("parcel_id", "ancestor_ids"), "parcel_id")
    hit = hit.select(F.explode("ancestor_ids").alias("location_id"), "href").distinct()
    chosen = hit.join(overlays.select("overlay_id", "href"), "href", "left").select("location_id", "overlay_id", F.lit(False).alias("all_overlays"))
    chosen = chosen.filter("overlay_id is not null").distinct()
    rest = places.select("location_id").join(hit.select("location_id").distinct(), "location_id", "left_anti")
    return chosen.unionByName(rest.select("location_id", F.lit(None).cast("string").alias("overlay_id"), F.lit(True).alias("all_overlays")))


def best_images(links: DataFrame) -> DataFrame:
    """The first-ranked image of each record."""
    return links.filter("rank = 1")


def bundle_layout(records: DataFrame, trails: DataFrame, best: DataFrame, root: str, images: DataFrame) -> DataFrame:
    """Paths, status and notes of every record in a bundle export.

    ``images`` has asset_id, url, format, http_status, truncated of the recorded responses.
    """
    df = records.join(trails, "location_id", "left").join(
        best.select("parcel_id", "asset_id", F.col("confidence").alias("association"), F.col("reason").alias("association_reason")), "parcel_id", "left"
    )
    df = df.join(images, "asset_id", "left")
    trail = F.coalesce("trail", "folder_path", F.array().cast("array<string>"))
    df = stage(df, _trail=trail)
    sub = F.filter(F.transform(F.slice("_trail", F.lit(2), F.greatest(F.size("_trail") - 1, F.lit(0))), lambda s: safe_segment(s)), lambda s: s != "")
    base = F.coalesce(F.nullif(safe_segment(F.coalesce("reference", "name")), F.lit("")), F.concat(F.lit("record_"), F.col("parcel_id")))
    df = stage(df, _sub=F.nullif(F.array_join(sub, "/"), F.lit("")), _base=base)
    kml = F.when(F.col("kml_available"), F.concat_ws("/", F.lit(root), F.lit("KML"), "_sub", kml_filename(F.col("_base"), F.lit("record"))))
    fetched = F.col("asset_id").isNotNull() & F.col("http_status").isNotNull() & (F.col("http_status") < 400) & ~F.col("truncated")
    image = F.when(fetched, F.concat_ws("/", F.lit(root), F.lit("Images"), "_sub", F.concat("_base", saved_extension(F.col("url"), F.col("format")))))
    df = stage(df, kml_path=kml, image_path=image)
    notes = F.array_compact(
        F.array(
            F.when(
                F.col("kml_path").isNull(),
                F.when(F.col("geometry_availability") == "image-only", "No KML: the source published a map image for this record but no geographic coordinates.")
                .otherwise("No KML: the source geometry could not be verified."),
            ),
            F.when(F.col("asset_id").isNull(), "No image was associated with this record.")
            .when(F.col("http_status").isNull(), "Image skipped: the request failed.")
            .when(F.col("http_status") >= 400, F.concat(F.lit("Image skipped: the server responded HTTP "), F.col("http_status").cast("string"), F.lit(".")))
            .when(F.col("truncated"), "Image skipped: it exceeded the per-file size limit.")
            .when(
                F.col("association") != "verified",
                F.concat(F.lit('Image association is "'), F.col("association"), F.lit('": '), F.col("association_reason"), F.lit(" Check it before relying on the pairing.")),
            ),
        )
    )
    got = F.col("kml_path").isNotNull().cast("int") + F.col("image_path").isNotNull().cast("int")
    status = F.when(got == 2, "complete").when(got == 1, "partial").otherwise("failed")
    return df.withColumns({"status": status, "notes": notes, "location_trail": F.col("_trail")}).drop("_trail", "_sub", "_base", "trail")


def export_contents(layout: DataFrame, group: list[str]) -> DataFrame:
    """Totals of a bundle: records, with KML, with an image, and by status."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return layout.groupBy(*group).agg(
        F.count(F.lit(1)).alias("records"), F.count("kml_path").alias("with_kml"), F.count("image_path").alias("with_image"),
        is_("complete"), is_("partial"), is_("failed"),
    )


def geojson_lines(records: DataFrame) -> DataFrame:
    """Each parcel with geometry as one GeoJSON feature line, in WGS 84, keyed by map.

    Source properties come after the record's own fields. Written as text per map this is
    newline-delimited GeoJSON; no map is ever collected into one value.
    """
    from .kml import geometry_json

    own = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.to_json(F.struct(F.col(c).alias("v"))).alias("j"))
            for k, c in (
                ("name", "name"), ("reference", "reference"), ("areaSquareMetres", "area_square_metres"), ("areaBasis", "area_basis"),
                ("sourceCrs", "source_crs"), ("transformed", "transformed"), ("geometrySource", "geometry_source"), ("sourcePage", "source_page"),
            )
        ]
    )
    value = lambda j: F.coalesce(F.nullif(F.regexp_extract(j, r'(?s)^\{"v":(.*)\}$', 1), F.lit("")), F.lit("null"))
    quoted = lambda text: F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    given = F.transform("entries", lambda e: F.struct(e["key"].alias("key"), quoted(e["value"]).alias("j")))
    kept = F.filter(own, lambda o: ~F.exists("entries", lambda e: e["key"] == o["key"]))
    fields = F.concat(F.transform(kept, lambda o: F.concat(quoted(o["key"]), F.lit(":"), value(o["j"]))),
                      F.transform(given, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["j"])))
    line = F.concat(
        F.lit('{"type":"Feature","id":'), quoted(F.col("parcel_id")), F.lit(',"properties":{'), F.array_join(fields, ","),
        F.lit('},"geometry":'), geometry_json(F.col("geometry_type"), F.col("parts")), F.lit("}"),
    )
    return records.select("map_id", "parcel_id", line.alias("value"))
