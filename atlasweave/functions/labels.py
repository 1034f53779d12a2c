"""Readable labels, keys and messages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a small fixed table, else ``default``."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(literal, key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def size_label(bucket: Column) -> Column:
    return lookup(bucket, K.SIZE_LABELS, "Unknown size")


def category_label(category: Column) -> Column:
    return lookup(category, K.CATEGORY_LABELS, "Unknown")


def orientation_label(orientation: Column) -> Column:
    return lookup(orientation, K.ORIENTATION_LABELS, "Unknown")


def status_label(status: Column) -> Column:
    return lookup(status, K.STATUS_LABELS, "Not verified")


def kind_label(kind: Column) -> Column:
    return lookup(kind, K.KIND_LABELS, "Images")


def discovery_label(source: Column) -> Column:
    return lookup(source, K.DISCOVERY_LABELS, "META")


def format_key(kind: Column, geo_format: Column, extension: Column, mime: Column) -> Column:
    """Facet format: geographic format, else extension, else MIME subtype, else ``other``."""
    short = lambda c: F.when(c == "jpeg", "jpg").otherwise(c)
    subtype = F.substring(mime, 7, 100)
    for long, brief in (("svg+xml", "svg"), ("x-icon", "ico")):
        subtype = F.replace(subtype, F.lit(long), F.lit(brief))
    return (
        F.when((kind == "geo") & geo_format.isNotNull(), geo_format)
        .when(F.coalesce(extension, F.lit("")) != "", short(extension))
        .when(mime.startswith("image/"), short(subtype))
        .otherwise("other")
    )


def http_message(status: Column) -> Column:
    other = F.concat(F.lit("The server responded with HTTP "), status.cast("string"), F.lit("."))
    return lookup(status.cast("int"), K.HTTP_MESSAGES, other)


def page_http_detail(status: Column) -> Column:
    head = F.concat(F.lit("HTTP status: "), status.cast("string"), F.lit("\n"))
    return F.concat(head, lookup(status.cast("int"), K.PAGE_HTTP_DETAILS, K.PAGE_HTTP_DEFAULT))


def base_mime(content_type: Column) -> Column:
    """Content type without parameters, lower-cased; null when empty."""
    return F.nullif(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), F.lit(""))


def mime_of_type(kind: Column) -> Column:
    return F.when(kind.isNotNull(), lookup(F.lower(kind), K.MIME_BY_TYPE, F.concat(F.lit("image/"), F.lower(kind))))


def saved_extension(url: Column, fmt: Column) -> Column:
    """Extension for a saved file, from its URL, else its format, else ``.img``."""
    own = F.lower(F.regexp_extract(url, r"(?i)\.([a-z0-9]{2,5})(?:$|\?)", 1))
    return (
        F.when(own != "", F.concat(F.lit("."), own))
        .when(fmt.contains("/"), F.concat(F.lit("."), F.replace(F.split_part(fmt, F.lit("/"), F.lit(2)), F.lit("jpeg"), F.lit("jpg"))))
        .when(F.coalesce(fmt, F.lit("")) != "", F.concat(F.lit("."), fmt))
        .otherwise(".img")
    )


def area_text(square_metres: Column) -> Column:
    """Area in the unit a land record would use."""
    hectares = F.format_string("%.2f hectares", F.round(square_metres / K.SQUARE_METRES_PER_HECTARE, 2))
    metres = F.concat(F.format_number(F.floor(square_metres + 0.5), 0), F.lit(" m²"))
    return (
        F.when(square_metres.isNull(), "Not available from source")
        .when(square_metres >= K.SQUARE_METRES_PER_HECTARE, hectares)
        .otherwise(metres)
    )


def coordinate_text(value: Column) -> Column:
    """Coordinate to six decimals, trailing zeros dropped."""
    return F.regexp_replace(F.format_string("%.6f", F.round(value, 6)), r"\.?0+$", "")
