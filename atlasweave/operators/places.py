"""Location hierarchy: paths of places, nodes with stable ids, roll-ups, trails and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import land
from ..functions.stages import let, stage
from ..functions.text import strip

STEPS = "array<struct<name:string,kind:string,evidence:string>>"


def _steps(names: Column, evidence: str) -> Column:
    return F.transform(
        names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(evidence).alias("evidence"))
    ).cast(STEPS)


def url_steps(places: Column) -> Column:
    """Path implied by a page URL."""
    return _steps(places, "url-path")


def location_steps(entries: Column, document: Column, folders: Column, url_places: Column) -> Column:
    """Where a feature lies: place attributes, else document and folders, else document, else page URL."""
    stated = F.transform(
        land.place_steps(entries),
        lambda s: F.struct(s["name"].alias("name"), s["kind"].alias("kind"), F.lit("feature-property").alias("evidence")),
    ).cast(STEPS)
    titled = _steps(F.array_compact(F.array(document)), "kml-document")
    return let(
        stated,
        lambda s: F.when(F.size(s) > 0, s)
        .when(F.size(folders) > 0, F.concat(titled, _steps(folders, "kml-folder")))
        .when(document.isNotNull(), titled)
        .otherwise(url_steps(url_places)),
    )


def with_location(df: DataFrame, steps: str = "steps") -> DataFrame:
    """Add ``nodes`` (the chain of places with ids), ``location_id`` and ``ancestor_ids`` (itself last).

    A node's id is the hash of its parent's id and its lower-cased name, so the same chain of
    names gives the same ids everywhere without looking anything up.
    """
    usable = F.filter(
        F.transform(steps, lambda s: F.struct(strip(s["name"]).alias("name"), s["kind"].alias("kind"), s["evidence"].alias("evidence"))),
        lambda s: s["name"] != "",
    )
    df = stage(df, _usable=usable)
    node = "struct<id:string,parent_id:string,name:string,kind:string,evidence:string,depth:int>"

    def grow(acc: Column, s: Column) -> Column:
        parent = F.try_element_at(acc, F.lit(-1))["id"]
        seed = F.concat(F.coalesce(parent, F.lit("root")), F.lit("|"), F.lower(s["name"]))
        made = F.struct(
            F.concat(F.lit("loc_"), F.substring(F.sha1(seed), 1, 16)).alias("id"), parent.alias("parent_id"), s["name"].alias("name"),
            s["kind"].alias("kind"), s["evidence"].alias("evidence"), F.size(acc).alias("depth"),
        )
        return F.array_append(acc, made)

    df = stage(df, nodes=F.aggregate("_usable", F.array().cast(f"array<{node}>"), grow)).drop("_usable")
    ids = F.transform("nodes", lambda n: n["id"])
    return stage(df, ancestor_ids=ids, location_id=F.try_element_at(ids, F.lit(-1)))


def locations(placements: DataFrame) -> DataFrame:
    """One row per place from rows placed by :func:`with_location` with ``ord`` and ``source_page``.

    First-seen name and source; kind as stated, else read from the name, an unknown one
    replaced by the first later statement; evidence in first-seen order. Rows are first
    reduced to distinct paths, so the explode is over places, not over parcels.
    """
    shape = lambda f: F.transform("nodes", lambda n: n[f])
    paths = placements.filter("location_id is not null").groupBy(
        "location_id", shape("kind").alias("kinds"), shape("evidence").alias("evidences")
    ).agg(F.min(F.struct("ord", "source_page", "nodes")).alias("f"))
    nodes = paths.select("f.ord", "f.source_page", F.posexplode("f.nodes").alias("i", "n"), F.col("f.nodes").alias("all"))
    chain = F.transform(F.slice("all", F.lit(1), F.col("i") + 1), lambda n: n["id"])
    nodes = nodes.select("ord", "source_page", "n.*", chain.alias("ancestor_ids"))
    seen = lambda e: F.min(F.when(F.col("evidence") == e, F.col("ord")))
    kinds = ["url-path", "kml-folder", "kml-document", "feature-property"]
    grouped = nodes.groupBy("id").agg(
        F.min(F.struct("ord", "name", "kind", "parent_id", "source_page", "depth", "ancestor_ids")).alias("f"),
        F.min(F.when(F.col("kind").isNotNull(), F.struct("ord", "kind"))).alias("stated"),
        *[seen(e).alias(f"e{i}") for i, e in enumerate(kinds)],
    )
    read = land.location_kind(F.col("f.name"))
    kind = F.coalesce(F.col("f.kind"), F.nullif(read, F.lit("unknown")), F.col("stated.kind"), F.lit("unknown"))
    listed = F.filter(
        F.array(*[F.struct(F.col(f"e{i}").alias("ord"), F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(kinds)]),
        lambda x: x["ord"].isNotNull(),
    )
    return grouped.select(
        F.col("id").alias("location_id"), F.col("f.name").alias("name"), kind.alias("kind"), F.col("f.parent_id").alias("parent_id"),
        F.col("f.depth").alias("depth"), F.col("f.source_page").alias("source_page"),
        F.transform(F.array_sort(listed), lambda x: x["e"]).alias("evidence"), F.col("f.ancestor_ids").alias("ancestor_ids"),
    )


COUNTS = ["map_count", "parcel_count", "image_count", "geometry_count"]


def location_rollups(counts: DataFrame) -> DataFrame:
    """Counts of a place and everything below it.

    ``counts`` has location_id, ancestor_ids and the four counts per map or parcel. They are
    summed per place first, and only the places are exploded to their ancestors.
    """
    own = counts.filter("location_id is not null").groupBy("location_id").agg(
        F.min("ancestor_ids").alias("ancestor_ids"), *[F.sum(c).alias(c) for c in COUNTS]
    )
    up = own.select(F.explode("ancestor_ids").alias("location_id"), *COUNTS)
    return up.groupBy("location_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def under(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``df`` that lie at or below one of ``places``."""
    chains = df.select("location_id", F.explode("ancestor_ids").alias("_id")).distinct()
    found = chains.join(places.select(F.col("location_id").alias("_id")), "_id", "left_semi").select("location_id").distinct()
    return df.join(found, "location_id", "left_semi")


def location_trails(places: DataFrame) -> DataFrame:
    """Breadcrumb of each place: names of its ancestors, outermost first, itself last."""
    steps = places.select("location_id", F.posexplode("ancestor_ids").alias("i", "step_id"))
    names = places.select(F.col("location_id").alias("step_id"), "name")
    joined = steps.join(names, "step_id")
    # A trail is as long as the hierarchy is deep.
    return joined.groupBy("location_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]).alias("trail")
    )


def location_descendants(places: DataFrame, root_id: Column | str) -> DataFrame:
    """The whole subtree of a place, itself included: no recursion, every row carries its ancestors."""
    root = F.lit(root_id) if isinstance(root_id, str) else root_id
    return places.filter(F.array_contains("ancestor_ids", root))


def root_locations(places: DataFrame, limit: int | None = 60) -> DataFrame:
    """Top-level places by what was found under them: the first ``limit``, or all for None."""
    order = [F.desc("parcel_count"), F.desc("geometry_count"), "name", "location_id"]
    ranked = places.filter("parent_id is null").orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def search_locations(places: DataFrame, query: str, limit: int | None = 60) -> DataFrame:
    """Places whose name contains the text, ranked by parcels; an empty text lists the roots."""
    needle = query.strip().lower()
    if not needle:
        return root_locations(places, limit)
    found = places.filter(F.lower("name").contains(needle)).orderBy(F.desc("parcel_count"), "name", "location_id")
    return found if limit is None else found.limit(limit)
