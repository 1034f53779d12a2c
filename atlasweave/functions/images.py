"""Image shape, headers, hashes, sniffing and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import urls as U
from .stages import stage
from .text import tokenize


def _known(width: Column, height: Column) -> Column:
    return (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(_known(width, height), F.round(width / height, 4))


def orientation(width: Column, height: Column) -> Column:
    ratio = width / height
    return (
        F.when(~_known(width, height), "unknown")
        .when(ratio >= 2.4, "panorama")
        .when(ratio > 1.08, "landscape")
        .when(ratio < 0.92, "portrait")
        .otherwise("square")
    )


def size_bucket(width: Column, height: Column) -> Column:
    longest = F.greatest(width, height)
    return (
        F.when(~_known(width, height), "unknown")
        .when(longest < 100, "tiny")
        .when(longest < 400, "small")
        .when(longest < 1000, "medium")
        .when(longest < 2000, "large")
        .otherwise("very-large")
    )


def below_minimum(kind: Column, width: Column, height: Column, min_width: int = 100, min_height: int = 100) -> Column:
    small = (width < min_width) | (height < min_height)
    return (kind == "image") & _known(width, height) & small


def content_hash(body: Column, truncated: Column) -> Column:
    """SHA-256 of complete bodies only; a partial body has no identity."""
    return F.when(~truncated, F.sha2(body, 256))


def _uint(body: Column, start: int, length: int, little: bool = False) -> Column:
    digits = F.hex(F.substring(body, start, length))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(length))])
    return F.conv(digits, 16, 10).cast("int")


# JPEG start-of-frame markers, markers without a length, and CSS lengths in pixels.
_JPEG_FRAMES = ["C0", "C1", "C2", "C3", "C5", "C6", "C7", "C9", "CA", "CB", "CD", "CE", "CF"]
_JPEG_BARE = ["01", "D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8"]
_PIXELS = {"in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72, "pc": 16.0, "em": 16.0, "ex": 8.0, "px": 1.0}


def jpeg_size(body: Column) -> Column:
    """``struct<width, height>`` from the first frame header of a JPEG body; null where the walk meets none.

    Segments tell their lengths, so sizes inside a payload (a thumbnail, say) are stepped over. Each step of the fold reads
    one marker or skips one fill byte, both of which begin with FF; so a body is walked through in as many steps as it
    has such bytes, however long its segments are.
    """
    bytes_ff = F.length(F.regexp_replace(F.decode(body, "ISO-8859-1"), "[^\u00ff]", ""))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        marker = F.hex(F.substring(body, at, 2))
        kind = F.substring(marker, 3, 2)
        whole = F.length(body) >= at + 8
        found = kind.isin(_JPEG_FRAMES) & whole
        following = (
            F.when(~marker.startswith("FF") | kind.isin("DA", "D9") | kind.isin(_JPEG_FRAMES), 0)
            .when(kind == "FF", at + 1)
            .when(kind.isin(_JPEG_BARE), at + 2)
            .otherwise(F.coalesce(at + 2 + F.greatest(_uint(body, at + 2, 2), F.lit(2)), F.lit(0)))
        )
        size = F.when(found, F.struct(_uint(body, at + 7, 2).alias("width"), _uint(body, at + 5, 2).alias("height")))
        return F.when(at == 0, acc).otherwise(F.struct(following.alias("at"), size.alias("size")))

    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("struct<width:int,height:int>").alias("size"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(bytes_ff, F.lit(1))), start, step)["size"]


def _svg_tag(text: Column) -> Column:
    """Text behind ``<svg`` of the root element, past declarations, comments and a document type."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>", "")
    bare = F.regexp_replace(bare, r"(?s)^[^<]*<!(?i:doctype)[^<>\[]*(\[.*?\]\s*)?>", "")
    return F.regexp_extract(bare, r"(?s)^[^<]*<(?:\w+:)?svg(?=[\s/>])(.*)", 1)


def svg_size(body: Column) -> Column:
    """``struct<width, height>`` of an SVG root: its lengths in pixels, missing ones by the proportions of ``viewBox``.

    Attributes are matched one behind the other, so a sign inside a quoted value ends nothing; a root tag that
    is cut off has no size. Percentages count as missing.
    """
    tag = _svg_tag(F.decode(body, "ISO-8859-1"))
    listed = F.regexp_extract_all(tag, F.lit(r"\G(\s*[^\s=>\"'/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))"), F.lit(1))
    closed = F.substring(tag, F.aggregate(listed, F.lit(1), lambda n, a: n + F.length(a)), F.lit(1 << 20)).rlike(r"^\s*/?>")
    value = lambda name: F.get(F.filter(listed, lambda a: a.rlike(rf"^\s*{name}\s*=")), F.lit(0))
    quoted = lambda attribute: F.regexp_extract(attribute, r"(?s)=\s*[\"'](.*)[\"']$", 1)

    def pixels(length: Column) -> Column:
        number = F.regexp_extract(length, r"^\s*([0-9]*\.?[0-9]+(?:[eE][+-]?\d+)?)\s*(?:in|cm|mm|pt|pc|em|ex|px)?\s*$", 1)
        unit = F.regexp_extract(length, r"(in|cm|mm|pt|pc|em|ex|px)\s*$", 1)
        scale = F.lit(1.0)
        for name, size in _PIXELS.items():
            scale = F.when(unit == name, size).otherwise(scale)
        return F.when(number != "", F.round(number.cast("double") * scale)).cast("int")

    box = F.split(F.trim(F.regexp_replace(quoted(value("viewBox")), r"[\s,]+", " ")), " ")
    box_width, box_height = (F.try_element_at(box, F.lit(n)).try_cast("double") for n in (3, 4))
    ratio = F.when((box_width > 0) & (box_height > 0), box_width / box_height)
    width, height = pixels(quoted(value("width"))), pixels(quoted(value("height")))
    size = F.struct(
        F.coalesce(width, F.floor(height * ratio), F.round(box_width)).cast("int").alias("width"),
        F.coalesce(height, F.floor(width / ratio), F.round(box_height)).cast("int").alias("height"),
    )
    return F.when(closed, size)


def _webp_size(body: Column) -> Column:
    """``struct<width, height>`` by the three kinds of first chunk; the sizes of the later two are stored less one."""
    chunk = F.decode(F.substring(body, 13, 4), "ISO-8859-1")
    packed = F.conv(F.concat(*[F.hex(F.substring(body, n, 1)) for n in (25, 24, 23, 22)]), 16, 10).cast("bigint")
    low = lambda n: _uint(body, n, 2, True).bitwiseAND(0x3FFF)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    return (
        F.when(chunk == "VP8 ", size(low(27), low(29)))
        .when(chunk == "VP8L", size(packed.bitwiseAND(0x3FFF) + 1, F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1))
        .when(chunk == "VP8X", size(_uint(body, 25, 3, True) + 1, _uint(body, 28, 3, True) + 1))
    )


def header_size(body: Column) -> Column:
    """``struct<type, width, height>`` from the bytes of a PNG, GIF, BMP, JPEG, WebP, ICO or SVG body; null if unreadable."""
    head = F.hex(F.substring(body, 1, 12))
    fixed = lambda kind, w, h, n, little: F.struct(F.lit(kind).alias("type"), _uint(body, w, n, little).alias("width"), _uint(body, h, n, little).alias("height"))
    read = lambda kind, size: F.struct(F.lit(kind).alias("type"), size["width"].alias("width"), size["height"].alias("height"))
    # the sides of an icon are single bytes, 0 for 256
    icon = F.struct(F.lit("ico").alias("type"), *(F.when(_uint(body, n, 1) == 0, 256).otherwise(_uint(body, n, 1)).alias(side) for n, side in ((7, "width"), (8, "height"))))
    text = F.decode(F.substring(body, 1, 512), "ISO-8859-1")
    found = (
        F.when(head.startswith("89504E470D0A1A0A"), fixed("png", 17, 21, 4, False))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), fixed("gif", 7, 9, 2, True))
        .when(head.startswith("424D"), fixed("bmp", 19, 23, 4, True))
        .when(head.startswith("FFD8FF"), read("jpg", jpeg_size(body)))
        .when(head.startswith("52494646") & head.endswith("57454250"), read("webp", _webp_size(body)))
        .when(head.startswith("00000100"), icon)
        .when(text.rlike(r"^(\u00ef\u00bb\u00bf)?\s*<"), read("svg", svg_size(body)))
    )
    usable = (F.length(body) >= 16) & (found["width"] > 0) & (found["height"] > 0)
    return F.when(usable, found)


def geo_sniff(body: Column, fmt: Column) -> Column:
    """``struct<ok, note>``: whether the first bytes fit the format a file claims to be."""
    head = F.substring(body, 1, 512)
    magic = F.hex(F.substring(body, 1, 3))
    # Only ASCII marks are looked for, so a byte-wise decoding never fails; the first three
    # characters skipped are a UTF-8 byte order mark.
    text = F.regexp_replace(F.decode(head, "ISO-8859-1"), "^(\u00ef\u00bb\u00bf)?\\s*", "")
    result = lambda ok, note=None: F.struct(F.lit(ok).alias("ok"), (note if isinstance(note, Column) else F.lit(note)).cast("string").alias("note"))
    root = (
        F.when(fmt == "kml", text.rlike("(?i)<kml"))
        .when(fmt == "gpx", text.rlike("(?i)<gpx"))
        .otherwise(text.rlike("(?i)<[a-z]*:?(FeatureCollection|gml)"))
    )
    no_root = F.concat(F.lit("The file is XML but no <"), fmt, F.lit("> root element was seen in its first bytes."))
    return (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, result(False, "The server returned an empty file."))
        .when(
            fmt.isin("kmz", "shapefile-zip"),
            F.when(magic.isin("504B03", "504B05", "504B07"), result(True)).otherwise(
                result(False, "The server did not return a zip archive for this file.")
            ),
        )
        .when(
            fmt.isin("geojson", "topojson"),
            F.when(text.rlike(r"^\s*[{\[]"), result(True)).otherwise(result(False, "The response was not JSON.")),
        )
        .when(text.rlike(r"^\s*<"), F.when(root, result(True)).otherwise(result(True, no_root)))
        .otherwise(result(False, "The response did not look like a geographic data file."))
    )


# ------------------------------------------------------------------------------ category

_SIGNALS = "array<struct<category:string,weight:int,reason:string>>"


def _signal(condition: Column, category, weight, reason) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    one = F.array(
        F.struct(lit(category).alias("category"), lit(weight).cast("int").alias("weight"), lit(reason).alias("reason"))
    )
    return F.coalesce(F.when(condition, one), F.array().cast(_SIGNALS))


def _quoted(words: Column, limit: int) -> Column:
    return F.array_join(F.transform(F.slice(words, 1, limit), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", ")


def classify(df: DataFrame) -> DataFrame:
    """Add ``category``, ``category_confidence`` and ``category_reasons``.

    Expects url, filename, extension, mime_type, width, height, alt_text, title, source_types,
    context_hints, page_url, page_title, declared_width and declared_height. Signals are kept
    in a fixed order because the first category to reach the top weight wins a tie.
    """
    df = U.with_url_parts(df, F.col("url"), "_u")
    df = U.with_url_parts(df, F.col("page_url"), "_g")
    safe_path = lambda p, raw: F.coalesce(F.concat_ws(" ", F.col(f"{p}_path"), F.nullif(F.col(f"{p}_query"), F.lit("?"))), F.col(raw))
    df = stage(
        df,
        _words=F.array_distinct(
            tokenize(
                F.concat_ws(" ", "filename", F.coalesce(F.when(F.col("_u_host").isNotNull(), safe_path("_u", "url")), "url"),
                            "alt_text", "title", F.array_join("context_hints", " "))
            )
        ),
        _page_words=F.array_distinct(
            tokenize(F.concat_ws(" ", F.when(F.col("_g_host").isNotNull(), safe_path("_g", "page_url")).otherwise(F.col("page_url")), "page_title"))
        ),
        _w=F.coalesce("width", "declared_width"),
        _h=F.coalesce("height", "declared_height"),
    )
    df = U.drop_parts(df, "_u", "_g")
    listed = {c: F.array(*[F.lit(w) for w in words]) for c, _, words in K.CATEGORY_KEYWORDS}
    df = stage(
        df,
        **{f"_hit_{c}": F.array_intersect(words, F.col("_words")) for c, words in listed.items()},
        _page_hits=F.array_intersect(listed["map"], F.col("_page_words")),
    )
    w, h = F.col("_w"), F.col("_h")
    area, ratio = w.cast("bigint") * h, w / h
    sized = _known(w, h)
    shape = F.concat(w.cast("string"), F.lit("×"), h.cast("string"))
    parts = []
    for category, weight, _ in K.CATEGORY_KEYWORDS:
        hits = F.col(f"_hit_{category}")
        parts.append(
            _signal(
                F.size(hits) > 0, category, F.lit(weight) + F.least(F.size(hits) - 1, F.lit(2)),
                F.concat(F.lit("filename, alt text or markup mentions "), _quoted(hits, 3)),
            )
        )
    parts.append(
        _signal(
            (F.size("_hit_map") > 0) & (F.size("_page_hits") > 0), "map",
            F.lit(1) + F.least(F.size("_page_hits"), F.lit(2)),
            F.concat(F.lit("found on a page about "), _quoted(F.col("_page_hits"), 2)),
        )
    )
    table = F.create_map(
        *[
            x
            for source, category, weight, reason in K.SOURCE_SIGNALS
            for x in (
                F.lit(source),
                F.struct(F.lit(category).alias("category"), F.lit(weight).alias("weight"), F.lit(reason).alias("reason")),
            )
        ]
    )
    parts.append(
        F.filter(F.transform("source_types", lambda s: F.try_element_at(table, s)), lambda s: s.isNotNull()).cast(_SIGNALS)
    )
    ext, mime = F.coalesce("extension", F.lit("")), F.coalesce("mime_type", F.lit(""))
    parts += [
        _signal((ext == "ico") | mime.isin("image/x-icon", "image/vnd.microsoft.icon"), "icon", 6, "served as an .ico icon file"),
        _signal(
            (ext == "svg") | (mime == "image/svg+xml"),
            F.when((w > 0) & (w <= 64), "icon").otherwise("illustration"), 2, "vector (SVG) asset",
        ),
        _signal(sized & (w <= 48) & (h <= 48), "icon", 5, F.concat(F.lit("very small ("), shape, F.lit(")"))),
        _signal(
            sized & ~((w <= 48) & (h <= 48)) & (w <= 128) & (h <= 128) & (F.abs(ratio - 1) < 0.25), "icon", 3,
            F.concat(F.lit("small and square ("), shape, F.lit(")")),
        ),
        _signal(
            sized & ~((w <= 48) & (h <= 48)) & ~((w <= 128) & (h <= 128) & (F.abs(ratio - 1) < 0.25)) & (w <= 320) & (h <= 320),
            "thumbnail", 2, F.concat(F.lit("thumbnail-sized ("), shape, F.lit(")")),
        ),
        _signal(
            sized & (ratio >= 3) & (w >= 900), "background", 2,
            F.format_string("very wide banner ratio (%.1f:1)", F.round(ratio, 1)),
        ),
        _signal(
            sized & (area >= 1_000_000) & (ratio > 0.5) & (ratio < 2), "photo", 1,
            F.concat(F.lit("large photographic dimensions ("), shape, F.lit(")")),
        ),
        _signal(
            sized & (area >= 400_000) & (ratio > 0.6) & (ratio < 2.2) & F.array_contains("_words", "map"), "map", 2,
            "large map-shaped raster",
        ),
        _signal((ext == "png") & (w > 0) & (w <= 64), "icon", 1, "small PNG, typical of UI iconography"),
    ]
    df = stage(df, _signals=F.concat(*parts))
    signals = F.col("_signals")
    weight_of = lambda c: F.aggregate(
        F.filter(signals, lambda s: s["category"] == c), F.lit(0), lambda acc, s: acc + s["weight"]
    )
    ranked = F.transform(
        F.array_distinct(F.transform(signals, lambda s: s["category"])),
        lambda c, i: F.struct((-weight_of(c)).alias("n"), i.alias("i"), c.alias("category")),
    )
    df = stage(df, _best=F.array_min(ranked), _sum=F.aggregate(signals, F.lit(0), lambda acc, s: acc + s["weight"]))
    best = F.col("_best")
    reasons = F.slice(
        F.array_distinct(
            F.transform(F.filter(signals, lambda s: s["category"] == best["category"]), lambda s: s["reason"])
        ),
        1, 4,
    )
    share = -best["n"] / F.greatest("_sum", F.lit(1))
    nothing = F.size(signals) == 0
    df = stage(
        df,
        category=F.when(nothing, "unknown").otherwise(best["category"]),
        category_confidence=F.when(nothing, 0.0).otherwise(F.round(F.least(F.greatest(share, F.lit(0.2)), F.lit(0.95)), 2)),
        category_reasons=F.when(nothing, F.array(F.lit("No distinguishing signals were found."))).otherwise(reasons),
    )
    helpers = ["_words", "_page_words", "_w", "_h", "_signals", "_best", "_sum", "_page_hits"]
    return df.drop(*helpers, *[f"_hit_{c}" for c in listed])
