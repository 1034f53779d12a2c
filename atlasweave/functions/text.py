"""Text column expressions. All are built-ins, so they stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as browsers treat it; valid in both Java and RE2 syntax.
SPACE = (
    r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
#: The characters of that class, for trimming without a regular expression.
SPACES = " \t\n\x0b\x0c\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The class behind a look at printable ASCII, which rules out most characters in one comparison instead of one a range.
_SPACE_RUN = rf"(?![!-~]){SPACE}+"


def squish(text: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def strip(text: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACES))


def clean_text(text: Column, limit: int = 500) -> Column:
    """Squished text cut to ``limit`` characters; null when nothing is left."""
    return F.substring(F.nullif(squish(text), F.lit("")), 1, limit)


def tokenize(text: Column) -> Column:
    """Lower-case alphanumeric tokens, percent escapes acting as separators."""
    spaced = F.regexp_replace(F.lower(text), "%[0-9a-f]{2}", " ")
    return F.filter(F.split(spaced, "[^a-z0-9]+"), lambda t: t != "")


def format_bytes(size: Column) -> Column:
    """Readable size: whole numbers from 10 up, one decimal below."""
    unit = F.when(size < 1024**2, "KB").when(size < 1024**3, "MB").otherwise("GB")
    value = (
        F.when(size < 1024**2, size / 1024)
        .when(size < 1024**3, size / (1024**2))
        .otherwise(size / (1024**3))
    )
    scaled = F.when(value < 10, F.format_string("%.1f", F.round(value, 1))).otherwise(
        F.floor(value + 0.5).cast("string")
    )
    return (
        F.when(size.isNull(), "—")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .otherwise(F.concat_ws(" ", scaled, unit))
    )


def decode_entities(text: Column) -> Column:
    """Decode the five predefined XML entities, ampersand first."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escape_xml(text: Column) -> Column:
    """Escape the five characters XML reserves."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def html_text(text: Column) -> Column:
    """Character data of an HTML fragment: tags dropped, common references decoded."""
    bare = F.regexp_replace(text, "<[^>]*>", "")
    for reference, char in (("&#39;", "'"), ("&nbsp;", " ")):
        bare = F.replace(bare, F.lit(reference), F.lit(char))
    return decode_entities(bare)


def _safe(text: Column) -> Column:
    dashed = F.regexp_replace(text, r"[\\/]", "_")
    kept = F.regexp_replace(dashed, r"[^\w\s.-]", "")
    return F.regexp_replace(kept, r"\s+", "_")


def safe_segment(text: Column, limit: int = 80) -> Column:
    """Folder or file stem that is safe on common file systems."""
    single = F.regexp_replace(_safe(text), "_+", "_")
    return F.substring(F.regexp_replace(single, r"^[._]+|[._]+$", ""), 1, limit)


def kml_filename(name: Column, fallback: Column) -> Column:
    base = F.coalesce(F.nullif(strip(name), F.lit("")), fallback)
    return F.concat(F.coalesce(F.nullif(safe_segment(base, 120), F.lit("")), fallback), F.lit(".kml"))


def safe_label(text: Column, limit: int, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.substring(_safe(text), 1, limit), F.lit("")), F.lit(fallback))


def safe_entry_name(raw: Column, fallback: Column) -> Column:
    """Last path segment only, with traversal parts and reserved characters removed."""
    decoded = percent_decode(strip(raw))
    parts = F.filter(
        F.split(F.replace(decoded, F.lit("\\"), F.lit("/")), "/"),
        lambda s: (s != "") & (s != ".") & (s != ".."),
    )
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    named = F.regexp_replace(F.regexp_replace(last, r'[\x00-\x1f\x7f<>:"|?*]', "_"), r"^\.+", "")
    return F.substring(F.coalesce(F.nullif(named, F.lit("")), fallback), 1, 180)


def _valid_utf8_or(decoded: Column, raw: Column) -> Column:
    return F.when(decoded.isNull() | decoded.contains("\ufffd"), raw).otherwise(decoded)


def percent_decode(text: Column) -> Column:
    """Percent-decode; text with a malformed escape comes back unchanged, as does ``+``."""
    guarded = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(
        text.contains("%"),
        F.when(text.rlike("%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)"), text).otherwise(
            _valid_utf8_or(F.try_url_decode(guarded), text)
        ),
    ).otherwise(text)


def number_text(value: Column) -> Column:
    """A double the way JSON writes it: no trailing ``.0`` and no exponent in the usual range."""
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(
        (value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")
    ).otherwise(plain)


def csv_cell(text: Column) -> Column:
    """RFC 4180 quoting of one cell; null is an empty cell."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike('[",\r\n]'), quoted).otherwise(text)
