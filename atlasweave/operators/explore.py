"""Filtering, faceting, sorting and selecting assets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.ordering import natural_key
from ..functions.text import tokenize

MAX_FACET_PAGES = 200
MAX_FOUND_PAGES = 40


@dataclass
class AssetFilters:
    """Optional facets; an empty list is no constraint."""

    search: str = ""
    kinds: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    sizes: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    orientations: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    source_pages: list[str] = field(default_factory=list)
    show_duplicates: bool = True
    show_below_minimum: bool = False
    only_selected: bool = False

    @property
    def active(self) -> bool:
        return self != AssetFilters()


def with_category_overrides(assets: DataFrame, overrides: DataFrame) -> DataFrame:
    """User-chosen categories (asset_id, category) win over detected ones."""
    chosen = overrides.select("asset_id", F.col("category").alias("_chosen"))
    df = assets.join(chosen, "asset_id", "left")
    return df.withColumn("category_was_overridden", F.col("_chosen").isNotNull()).withColumn(
        "category", F.coalesce("_chosen", "category")
    ).drop("_chosen")


def format_column() -> Column:
    return L.format_key(F.col("asset_kind"), F.col("geo_format"), F.col("extension"), F.col("mime_type"))


def search_text() -> Column:
    """The text a search looks in."""
    fields = ["filename", "alt_text", "title", "url", "source_page", "source_page_title", "source_page_label", "category"]
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields] + [F.array_join("source_types", " ")]
    return F.lower(F.concat_ws(" ", *parts))


def filter_assets(
    assets: DataFrame, filters: AssetFilters, references: DataFrame | None = None, selected: DataFrame | None = None
) -> DataFrame:
    """Assets meeting every given facet; page and id facets are semi-joins."""
    tests: list[Column] = []
    for column, values in (
        ("asset_kind", filters.kinds), ("size_bucket", filters.sizes), ("category", filters.categories),
        ("orientation", filters.orientations), ("status", filters.statuses),
    ):
        if values:
            tests.append(F.col(column).isin(*values))
    if filters.types:
        tests.append(format_column().isin(*filters.types))
    if not filters.show_below_minimum:
        tests.append(~F.col("below_minimum"))
    if not filters.show_duplicates:
        tests.append(~F.col("is_duplicate"))
    terms = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in filters.search.lower()).split()]
    tests += [search_text().contains(t) for t in terms]
    df = assets.filter(reduce(lambda a, b: a & b, tests)) if tests else assets
    if filters.source_pages:
        pages = references.filter(F.col("source_page").isin(*filters.source_pages)).select("asset_id")
        df = df.join(pages, "asset_id", "left_semi")
    if filters.only_selected:
        df = select_by_id(df, selected)
    return df


def select_by_id(rows: DataFrame, ids: DataFrame, key: str = "asset_id") -> DataFrame:
    """Rows whose id is in an explicit selection."""
    return rows.join(ids.select(key), key, "left_semi")


FACETS = {
    "kind": ("asset_kind", L.kind_label), "size": ("size_bucket", L.size_label), "category": ("category", L.category_label),
    "orientation": ("orientation", L.orientation_label), "status": ("status", L.status_label),
}


def facets(assets: DataFrame) -> DataFrame:
    """Counts of every facet value plus the two totals, in one pass over the assets.

    Long form ``(facet, value, label, count)``; each asset is exploded into its facet values
    and the counts combine map-side, so only a few dozen rows are shuffled per task.
    """
    pair = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    pairs = [pair(name, F.col(column)) for name, (column, _) in FACETS.items()]
    pairs.append(pair("type", format_column()))
    pairs.append(pair("total", F.when(F.col("below_minimum"), "below_minimum")))
    pairs.append(pair("total", F.when(F.col("is_duplicate"), "duplicates")))
    long = assets.select(F.inline(F.array(*pairs))).filter("value is not null")
    counts = long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    label = F.coalesce(
        *[F.when(F.col("facet") == name, make(F.col("value"))) for name, (_, make) in FACETS.items()],
        F.when(F.col("facet") == "type", F.upper("value")),
        F.col("value"),
    )
    return counts.select("facet", "value", label.alias("label"), "count")


def sorted_facets(facet_counts: DataFrame) -> DataFrame:
    """Facet values by count, then by value."""
    return facet_counts.orderBy("facet", F.desc("count"), "value")


def facet_pages(references: DataFrame, search: str = "", limit: int | None = None) -> DataFrame:
    """Distinct assets per source page, most first; a top-k report."""
    per_page = references.select("source_page", "asset_id").distinct().groupBy("source_page").agg(
        F.count(F.lit(1)).alias("count")
    )
    from ..functions.urls import with_page_label

    needle = search.strip().lower()
    top = limit or (MAX_FOUND_PAGES if needle else MAX_FACET_PAGES)
    first = lambda df: df.orderBy(F.desc("count"), "source_page")
    if not needle:  # only the pages that are listed need a label
        return first(with_page_label(first(per_page).limit(top), "source_page", "label"))
    df = with_page_label(per_page, "source_page", "label")
    return first(df.filter(F.lower("source_page").contains(needle) | F.lower("label").contains(needle))).limit(top)


SORT_KEYS = {
    "discovered": lambda: F.col("seq"),
    "filename": lambda: natural_key(F.col("filename")),
    "dimensions": lambda: F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0)),
    "filesize": lambda: F.coalesce("file_size", F.lit(-1)),
    "type": format_column,
    "source_page": lambda: F.lower("source_page"),
    "category": lambda: F.col("category"),
}


def sort_assets(assets: DataFrame, key: str = "discovered", descending: bool = False) -> DataFrame:
    """Assets in the order of ``key``; ``seq`` breaks ties and follows the direction."""
    df = assets.withColumn("sort_key", SORT_KEYS[key]())
    order = [F.desc("sort_key"), F.desc("seq")] if descending else [F.asc("sort_key"), F.asc("seq")]
    return df.orderBy(*order)


def search_terms(text: Column) -> Column:
    return tokenize(text)
