"""Land-record text: survey references, place kinds, stated areas and place attributes.

``entries`` is ``array<struct<key,value>>``: the properties of a feature in source order,
because "the first matching property wins" depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .stages import let
from .text import strip, tokenize


def _normal_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"\s+", "_")


def _any(words: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))


def survey_reference(name: Column, entries: Column) -> Column:
    """Reference property if there is one, else the number the name states, else null."""
    stated = F.filter(
        entries, lambda e: _normal_key(e["key"]).isin(*K.REFERENCE_KEYS) & (strip(e["value"]) != "")
    )
    text = strip(F.coalesce(name, F.lit("")))
    read = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in K.SURVEY_REGEXES]
    return F.coalesce(strip(F.get(stated, 0)["value"]), *read)


def location_kind(name: Column, hint: Column | None = None) -> Column:
    """Administrative level the words themselves state, else ``unknown``."""
    words = tokenize(name if hint is None else F.concat_ws(" ", name, hint))
    return F.coalesce(*[F.when(_any(words, listed), kind) for kind, listed in K.KIND_WORDS], F.lit("unknown"))


def stated_area(entries: Column) -> Column:
    """Area in square metres from the first usable area property; null when its unit is unknown."""
    digits = lambda e: F.regexp_replace(e["value"], r"[^\d.]", "").try_cast("double")
    usable = F.filter(
        entries,
        lambda e: F.lower(e["key"]).rlike("area|extent|acre|hectare|sqm|sq_m") & (F.coalesce(digits(e), F.lit(0.0)) > 0),
    )

    def area(x: Column) -> Column:
        unit, value = x["unit"], x["value"]
        return (
            F.when(unit.rlike(r"hectare|\bha\b"), value * K.SQUARE_METRES_PER_HECTARE)
            .when(unit.rlike("acre"), value * K.SQUARE_METRES_PER_ACRE)
            .when(unit.rlike(r"sq\.?\s*(m|metre|meter)|sqm|sq_m"), value)
        )

    read = lambda e: F.struct(F.concat_ws(" ", F.lower(e["key"]), F.lower(e["value"])).alias("unit"), digits(e).alias("value"))
    return let(F.get(usable, 0), lambda first: let(read(first), area))


def place_steps(entries: Column) -> Column:
    """``array<struct<name,kind>>`` of the places a feature's properties name, broadest first."""
    def named(kind: str, keys: list[str]) -> Column:
        hits = F.filter(entries, lambda e: _normal_key(e["key"]).isin(*keys) & (strip(e["value"]) != ""))
        return F.transform(hits, lambda e: F.struct(strip(e["value"]).alias("name"), F.lit(kind).alias("kind")))

    order = F.array(*[F.lit(k) for k in K.PLACE_ORDER])

    def ranked(x: Column) -> Column:
        first = F.filter(x["found"], lambda s, i: F.array_position(x["lowered"], F.lower(s["name"])) == i + 1)
        return F.array_sort(
            F.transform(
                first,
                lambda s, i: F.struct(F.array_position(order, s["kind"]).alias("level"), i.alias("i"), s["name"].alias("name"), s["kind"].alias("kind")),
            )
        )

    # Bound before they are compared: a name in a lambda stands for its whole definition, run again for every element.
    found = F.concat(*[named(kind, keys) for kind, keys in K.PLACE_KEYS])
    both = lambda f: F.struct(f.alias("found"), F.transform(f, lambda s: F.lower(s["name"])).alias("lowered"))
    listed = let(found, lambda f: let(both(f), ranked))
    return F.transform(listed, lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind")))
