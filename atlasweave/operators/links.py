"""Image-to-parcel links with stated confidence, without building page-by-page pairs.

A parcel keeps its twelve best images of the page its map was found on. Every way of
linking ranks images the same way (larger first, then earlier), so the twelve best overall
are among the twelve best of each way. Each way is an equality join on a key shared by few
rows - an overlay's file name, a reference text, a word, the page itself - reduced to twelve
images per key before it meets the parcels. A page with a third of all images and parcels
therefore costs twelve candidates per parcel and key, not images times parcels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ordering import number_rows
from ..functions.prefilter import likely
from ..functions.stages import stage
from ..functions.text import tokenize
from ..session import written

# Ways of linking, strongest first: fixed order.
WAYS = ["overlay", "reference", "wording", "place", "page"]
CONFIDENCE = {"overlay": "verified", "reference": "verified", "wording": "probable", "place": "probable", "page": "unverified"}


def _compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\w]", "")


def _best(df: DataFrame, most: int | None, *key: str) -> DataFrame:
    """The ``most`` largest images per key, limited before and after the shuffle; all of them without a limit."""
    if most is None:
        return df
    order = Window.partitionBy(*key).orderBy(F.desc("area"), "seq")
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def ordered_images(images: DataFrame) -> DataFrame:
    """``images`` with ``seq`` as their place among all, larger first, then earlier: a number instead of what they are ordered by,
    which would pass every join and rank of their links."""
    large = -F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))
    return number_rows(images.withColumn("_large", large), [], ["_large", "seq"], "_no").drop("seq", "_large").withColumnRenamed("_no", "seq")


def candidate_images(images: DataFrame, page_images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images on each of ``pages`` with what links look at. ``page_images`` is (source_page, asset_id).

    Pages are chosen first: most pages of a crawl have no parcels, and their images need no look.
    """
    text = F.lower(F.concat_ws(" ", "filename", F.coalesce("alt_text", F.lit("")), F.coalesce("title", F.lit(""))))
    known = images.select(
        "asset_id", "seq", "url", F.col("source_page").alias("first_page"),
        (F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))).alias("area"), text.alias("text"),
    )
    df = page_images.join(pages, "source_page", "left_semi").distinct().join(known, "asset_id")
    return stage(
        df, same_page=F.col("first_page") == F.col("source_page"), compact=_compact(F.col("text")), words=F.array_distinct(tokenize(F.col("text")))
    ).drop("text", "first_page")


def overlay_images(overlays: DataFrame, candidates: DataFrame) -> DataFrame:
    """(map_id, asset_id, overlay) of images an overlay of the map names, by URL or URL ending.

    ``overlays`` is (map_id, source_page, href, ord). A link with a slash ends in the image's
    file name; one without is an ending of it, looked up by the lengths that occur.
    """
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    links = overlays.withColumns({"slashed": F.col("href").contains("/"), "key": tail(F.col("href"))})
    short = links.filter("not slashed").groupBy("source_page").agg(F.collect_set(F.length("key")).alias("sizes"))
    pages = overlays.select("source_page").distinct().join(short, "source_page", "left")
    on_page = candidates.select("source_page", "asset_id", "seq", "area", "url").join(pages, "source_page")
    name = tail(F.col("url"))
    endings = F.transform(
        F.filter(F.coalesce("sizes", F.array().cast("array<int>")), lambda n: n <= F.length(name)),
        lambda n: F.struct(F.lit(False).alias("slashed"), F.substring(name, F.length(name) - n + 1, n).alias("key")),
    )
    whole = F.array(F.struct(F.lit(True).alias("slashed"), name.alias("key")))
    keyed = on_page.select("source_page", "asset_id", "seq", "area", "url", F.inline(F.concat(whole, endings)))
    hits = links.join(keyed, ["source_page", "slashed", "key"]).filter(F.endswith("url", F.col("href")))
    first = hits.groupBy("map_id", "asset_id").agg(
        F.min(F.struct("ord", "href")).alias("overlay"), F.min("seq").alias("seq"), F.max("area").alias("area")
    )
    return first


def reference_images(parcels: DataFrame, candidates: DataFrame, most: int | None = K.MAX_LINKED_IMAGES) -> DataFrame:
    """(source_page, key, image) where the image's text holds the parcel reference ``key``.

    Texts are cut at the reference lengths that occur on their page, which makes "contains"
    an equality; an image yields at most one row per position and length.
    """
    wanted = parcels.filter(F.length("ref_compact") >= 3).select("source_page", F.col("ref_compact").alias("key")).distinct()
    sizes = wanted.groupBy("source_page").agg(F.collect_set(F.length("key")).alias("sizes"))
    texts = candidates.select("source_page", "asset_id", "seq", "area", "compact").join(sizes, "source_page")
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter("sizes", lambda n: n <= F.length("compact")),
                lambda n: F.transform(F.sequence(F.lit(1), F.length("compact") - n + 1), lambda i: F.substring(F.col("compact"), i, n)),
            )
        )
    )
    keyed = texts.select("source_page", "asset_id", "seq", "area", F.explode(pieces).alias("key"))
    # Hardly any piece of a text is a reference: the others are dropped before they are shuffled.
    keyed = likely(keyed, wanted, ["source_page", "key"])
    return _best(keyed.join(wanted, ["source_page", "key"]), most, "source_page", "key")


def parcel_images(
    parcels: DataFrame, images: DataFrame, page_images: DataFrame, overlays: DataFrame, most: int | None = K.MAX_LINKED_IMAGES
) -> DataFrame:
    """The ``most`` best image links of each parcel, with confidence, reason and rank; every link where it is None.

    With a limit no join key meets more than that many images, so a page of many images and parcels is never paired whole.
    Without one the result itself holds each parcel of a page with each of its images, and ``rank`` is null: it would need
    an order over all of them. ``seq`` is the image's place among all images, larger first.
    ``parcels`` has parcel_id, map_id, source_page, reference, name and folder_path.
    """
    p = parcels.select("parcel_id", "map_id", "source_page", "reference", "name", "folder_path")
    long_words = lambda text, size: F.array_distinct(F.filter(tokenize(text), lambda t: F.length(t) > size))
    p = stage(
        p, ref_compact=_compact(F.coalesce("reference", F.lit(""))),
        wording=long_words(F.concat_ws(" ", F.coalesce("reference", F.lit("")), "name"), 2),
        place=long_words(F.array_join("folder_path", " "), 3),
    ).drop("folder_path", "name")
    # Both are read for every way of linking, so they are derived once.
    p = written(p)
    found = candidate_images(ordered_images(images), page_images, p.select("source_page").union(overlays.select("source_page")).distinct())
    # Few bytes that take much work, so they are spread by number of rows.
    found = written(found.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_page", "asset_id"))
    near = found.filter("same_page")
    by_overlay = overlay_images(overlays, found)
    words = lambda way: p.select("parcel_id", "source_page", F.explode(way).alias("key"))
    asked = words(F.concat("wording", "place"))
    spoken = likely(near.select("source_page", "asset_id", "seq", "area", F.explode("words").alias("key")), asked, ["source_page", "key"])
    by_word = _best(spoken, most, "source_page", "key")
    by_page = _best(near.select("source_page", "asset_id", "seq", "area"), most, "source_page")
    keep = ["parcel_id", "asset_id", "seq", "area"]
    linked = [
        p.select("parcel_id", "map_id").join(_best(by_overlay.drop("overlay"), most, "map_id"), "map_id"),
        p.select("parcel_id", "source_page", F.col("ref_compact").alias("key")).join(reference_images(p, found, most), ["source_page", "key"]),
        words("wording").join(by_word, ["source_page", "key"]),
        words("place").join(by_word, ["source_page", "key"]),
        p.select("parcel_id", "source_page").join(by_page, "source_page"),
    ]
    every = None
    for i, df in enumerate(linked):
        rows = df.select(*keep, F.lit(i).alias("way"))
        every = rows if every is None else every.unionByName(rows)
    # ``seq`` and ``area`` belong to the image: as keys they leave one number to aggregate, which needs no sort.
    best = every.groupBy(*keep).agg(F.min("way").alias("way"))
    confidence = F.when(F.col("way") <= 1, "verified").when(F.col("way") <= 3, "probable").otherwise("unverified")
    strength = F.when(F.col("way") <= 1, 0).when(F.col("way") <= 3, 1).otherwise(2)
    order = Window.partitionBy("parcel_id").orderBy(strength, F.desc("area"), "seq")
    if most is None:
        top = best.withColumn("rank", F.lit(None).cast("int"))
    else:
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    reason = (
        F.when(F.col("way") == 0, K.LINK_REASONS["overlay"])
        .when(F.col("way") == 1, F.concat(F.lit('The image filename or alt text contains the parcel reference "'), F.col("reference"), F.lit('".')))
        .when(F.col("way") == 2, K.LINK_REASONS["wording"])
        .when(F.col("way") == 3, K.LINK_REASONS["place"])
        .otherwise(K.LINK_REASONS["page"])
    )
    return top.join(p.select("parcel_id", "reference"), "parcel_id").select(
        "parcel_id", "asset_id", "rank", confidence.alias("confidence"), reason.alias("reason"), (F.col("way") == 0).alias("georeferenced"),
        "area", "seq",
    )
