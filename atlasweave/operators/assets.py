"""References consolidated into unique assets, their identity, duplicates and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import urls as U
from ..functions.ordering import number_rows
from ..functions.prefilter import likely
from ..functions.stages import stage

ORDER = ["page_seq", "path_rank", "ordinal", "original_url"]


def with_resolved_refs(refs: DataFrame) -> DataFrame:
    """Absolute form of references given as found in the page."""
    return U.with_resolved(refs, "original_url", "source_page", "resolved_url").filter("resolved_url is not null")


def _base_of_url() -> Column:
    """The page a URL is resolved against; empty where the URL is whole itself, so that it is one URL on every page."""
    raw = F.col("original_url")
    whole = raw.startswith("https://") | raw.startswith("http://") | U.is_plain(raw)
    return F.when(whole, "").otherwise(F.coalesce("source_page", F.lit("")))


#: What names a URL in a scan.
URL_KEY = ["scan_id", "original_url", "_base"]


def identified_refs(refs: DataFrame) -> DataFrame:
    """References with ``resolved_url`` and ``canonical_url``; those that give no URL are left out.

    A picture is named by many pages, so both forms are derived once for each distinct URL (and base, where the URL is not
    whole itself) and joined back; an often named URL is a skewed join, which adaptive execution splits.
    """
    keyed = refs.withColumn("_base", _base_of_url())
    urls = keyed.select("original_url", "_base").distinct()
    urls = U.with_resolved(urls, "original_url", "_base", "resolved_url").filter("resolved_url is not null")
    urls = U.with_canonical(urls, "resolved_url", "canonical_url")
    return keyed.join(urls, ["original_url", "_base"]).select(*refs.columns, "resolved_url", "canonical_url")


def merged_refs(refs: DataFrame) -> DataFrame:
    """References merged for each distinct URL of a scan (and base, as above): the first one, the first alt text and title,
    ``resolved_url``, ``canonical_url`` and ``asset_id``; URLs that give none are left out."""
    order = ORDER[:3]
    df = refs.withColumn("_base", _base_of_url()).groupBy(*URL_KEY).agg(
        F.min(F.struct(*order, "source_page", "alt_text", "title")).alias("first"),
        F.min(F.when(F.col("alt_text").isNotNull(), F.struct(*order, "alt_text"))).alias("alt"),
        F.min(F.when(F.col("title").isNotNull(), F.struct(*order, "title"))).alias("ttl"),
    )
    df = U.with_resolved(df, "original_url", "_base", "resolved_url").filter("resolved_url is not null")
    df = U.with_canonical(df, "resolved_url", "canonical_url")
    return stage(df, asset_id=U.asset_id(F.col("scan_id"), F.col("canonical_url")))


def assets_of_urls(urls: DataFrame) -> DataFrame:
    """One row per scan and canonical URL from :func:`merged_refs`, as :func:`consolidate_assets` gives it without its counts,
    source types and laziness: no reference is looked at again."""
    ordered = lambda c: [F.col(f"{c}.{n}") for n in ORDER[:3]] + [F.col("original_url")]
    given = lambda c, n: F.min(F.when(F.col(c).isNotNull(), F.struct(*ordered(c), F.col(f"{c}.{n}").alias(n)))).alias(c)
    merged = urls.groupBy("scan_id", "canonical_url", "asset_id").agg(
        F.min(F.struct(F.struct(*ordered("first")).alias("o"), "resolved_url", "first.source_page", "first.alt_text", "first.title")).alias("first"),
        given("alt", "alt_text"), given("ttl", "title"),
    )
    return merged.select(
        "scan_id", "canonical_url", "asset_id", F.col("first.resolved_url").alias("url"), F.col("first.o.original_url").alias("original_url"),
        F.col("first.source_page").alias("source_page"), F.col("alt.alt_text").alias("alt_text"), F.col("ttl.title").alias("title"),
        F.col("first.o").alias("first_seen"),
    )


def page_assets(refs: DataFrame, urls: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Distinct (source_page, asset_id): what each page shows, by the URLs of :func:`merged_refs`; all, or on ``pages`` only.

    With only some of the URLs, written before, only their assets are found. References to others are dropped before the shuffle.
    """
    named = refs.withColumn("_base", _base_of_url()).select(*URL_KEY, "source_page")
    known = urls.select(*URL_KEY, "asset_id")
    if pages is not None:
        named = likely(named, pages, ["source_page"])
    shown = likely(named, known, URL_KEY).join(known, URL_KEY).select("source_page", "asset_id").distinct()
    return shown if pages is None else shown.join(pages.select("source_page").distinct(), "source_page", "left_semi")


def in_scope(refs: DataFrame, site: str, external: bool = False) -> DataFrame:
    """References on the scanned site (sub-domains included) unless external ones are wanted."""
    if external:
        return refs
    df = U.with_url_parts(refs, F.col("resolved_url"), "_a")
    df = U.with_url_parts(df, F.col(site), "_o")
    df = df.filter(U.same_site(F.col("_a_host"), F.col("_o_host"), True))
    return U.drop_parts(df, "_a", "_o")


def asset_references(refs: DataFrame) -> DataFrame:
    """References with their asset's identity: one row per (scan, asset, page, type, descriptor, path).

    Expects scan_id, source_page, source_type, original_url, resolved_url, descriptor,
    element_path, alt_text, title, is_lazy and the order columns.
    """
    df = refs if "canonical_url" in refs.columns else U.with_canonical(refs, "resolved_url", "canonical_url")
    order = F.struct(*ORDER)
    # Hash by page as well as asset: a logo on every page is spread over all tasks.
    df = df.repartition("scan_id", "canonical_url", "source_page")
    return df.groupBy("scan_id", "canonical_url", "source_page", "source_type", "descriptor", "element_path").agg(
        F.min(F.struct(order.alias("o"), "original_url", "resolved_url", "source_page", "alt_text", "title")).alias("first"),
        F.min(F.when(F.col("alt_text").isNotNull(), F.struct(order.alias("o"), "alt_text"))).alias("alt"),
        F.min(F.when(F.col("title").isNotNull(), F.struct(order.alias("o"), "title"))).alias("ttl"),
        F.max("is_lazy").alias("is_lazy"),
    )


def consolidate_assets(refs: DataFrame) -> DataFrame:
    """One row per scan and canonical URL.

    First-seen URL, page, alt text and title; later alt texts and titles fill gaps only;
    source types in first-seen order; exact reference and page counts. Three aggregations,
    of which the first two share one shuffle; the last combines map-side.
    """
    per_ref = asset_references(refs)
    seen = lambda t: F.min(F.when(F.col("source_type") == t, F.col("first.o")))
    per_page = per_ref.groupBy("scan_id", "canonical_url", "source_page").agg(
        F.count(F.lit(1)).alias("refs"),
        F.min("first").alias("first"), F.min("alt").alias("alt"), F.min("ttl").alias("ttl"),
        F.max("is_lazy").alias("is_lazy"),
        *[seen(t).alias(f"t{i}") for i, t in enumerate(K.DISCOVERY_SOURCES)],
    )
    merged = per_page.groupBy("scan_id", "canonical_url").agg(
        F.sum("refs").alias("reference_count"),
        F.count(F.lit(1)).alias("page_count"),
        F.min("first").alias("first"), F.min("alt").alias("alt"), F.min("ttl").alias("ttl"),
        F.max("is_lazy").alias("is_lazy"),
        *[F.min(f"t{i}").alias(f"t{i}") for i in range(len(K.DISCOVERY_SOURCES))],
    )
    types = F.array(*[F.struct(F.col(f"t{i}").alias("o"), F.lit(t).alias("t")) for i, t in enumerate(K.DISCOVERY_SOURCES)])
    ordered = F.transform(F.array_sort(F.filter(types, lambda x: x["o"].isNotNull())), lambda x: x["t"])
    return merged.select(
        "scan_id", "canonical_url",
        U.asset_id(F.col("scan_id"), F.col("canonical_url")).alias("asset_id"),
        F.col("first.resolved_url").alias("url"), F.col("first.original_url").alias("original_url"),
        F.col("first.source_page").alias("source_page"),
        F.col("alt.alt_text").alias("alt_text"), F.col("ttl.title").alias("title"),
        ordered.alias("source_types"), "is_lazy", "reference_count", "page_count",
        F.col("first.o").alias("first_seen"),
    )


def describe_assets(assets: DataFrame) -> DataFrame:
    """Add file name, extension, geographic format, kind, page label and variant group."""
    df = U.with_page_label(describe_files(assets), "source_page", "source_page_label")
    return U.with_variant_group(df, "url", "variant_group")


def describe_files(assets: DataFrame) -> DataFrame:
    """Add what the file name tells: the name, extension, geographic format and kind."""
    df = U.with_filename(assets, "url", "filename")
    df = stage(df, geo_format=U.geo_format(F.col("filename")), extension=U.any_extension(F.col("filename")))
    return df.withColumn("asset_kind", F.when(F.col("geo_format").isNotNull(), "geo").otherwise("image"))


def with_sequence(assets: DataFrame) -> DataFrame:
    """Dense discovery number ``seq`` of each asset within its scan."""
    flat = assets.select("*", *[F.col(f"first_seen.{c}").alias(f"_{c}") for c in ORDER])
    return number_rows(flat, ["scan_id"], [f"_{c}" for c in ORDER] + ["canonical_url"], "seq").drop(*[f"_{c}" for c in ORDER])


def cap_assets(assets: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` assets of each scan, and a limit issue for every scan that had more."""
    over = assets.groupBy("scan_id").agg(F.max("seq").alias("found")).filter(F.col("found") > limit)
    issues = over.select(
        "scan_id", F.lit("limit").alias("kind"), F.lit("Image limit reached").alias("title"),
        F.concat(
            F.lit(f"The scan stopped collecting new assets at {limit}. "),
            F.lit('Raise "Maximum images" in settings to collect more.'),
        ).alias("detail"),
    )
    return assets.filter(F.col("seq") <= limit), issues


def context_hint_sets(refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct context hints per asset, in order of appearance, the first ``limit`` of them if that is given.

    ``refs`` carries scan_id, canonical_url, context_hint and the order columns. Distinct
    hints are reduced first; with ``limit``, the group limit of the window keeps no more per task.
    """
    from pyspark.sql import Window

    seen = refs.filter("context_hint is not null").groupBy("scan_id", "canonical_url", "context_hint").agg(
        F.min(F.struct(*ORDER)).alias("o")
    )
    if limit is not None:
        ranked = Window.partitionBy("scan_id", "canonical_url").orderBy("o", "context_hint")
        seen = seen.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= limit)
    return seen.groupBy("scan_id", "canonical_url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "context_hint"))), lambda x: x["context_hint"]).alias("context_hints")
    )


def mark_content_duplicates(assets: DataFrame) -> DataFrame:
    """Mark assets whose complete body equals an earlier one of the same scan.

    The original of a hash is an aggregate, not a window: a hash shared by a third of all
    assets combines map-side, and the join back is one that adaptive execution can split.
    Assets without a hash never enter the shuffle on it.
    """
    hashed = assets.filter("content_hash is not null")
    originals = hashed.groupBy("scan_id", "content_hash").agg(
        F.min(F.struct("seq", "asset_id")).alias("original")
    )
    joined = hashed.join(originals, ["scan_id", "content_hash"])
    copy = F.col("asset_id") != F.col("original.asset_id")
    marked = joined.withColumn("is_duplicate", copy).withColumn("duplicate_of", F.when(copy, F.col("original.asset_id")))
    marked = marked.withColumn(
        "status", F.when(copy & (F.col("status") == "available"), "duplicate").otherwise(F.col("status"))
    ).drop("original")
    rest = assets.filter("content_hash is null").withColumn("is_duplicate", F.lit(False)).withColumn(
        "duplicate_of", F.lit(None).cast("string")
    )
    return marked.unionByName(rest)


def dedupe_stats(assets: DataFrame) -> DataFrame:
    """References, unique assets, duplicates, duplicates by content and variant groups per scan."""
    groups = assets.groupBy("scan_id", "variant_group").agg(
        F.sum("reference_count").alias("references"), F.count(F.lit(1)).alias("unique"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(F.col("is_duplicate") & F.col("content_hash").isNotNull()).alias("by_content_hash"),
    )
    return groups.groupBy("scan_id").agg(
        F.sum("references").alias("references"), F.sum("unique").alias("unique_assets"),
        F.sum("duplicates").alias("duplicates"), F.sum("by_content_hash").alias("by_content_hash"),
        F.count("variant_group").alias("variant_groups"),
    )


def variant_rollup(assets: DataFrame) -> DataFrame:
    """Members of each variant group and its largest one."""
    area = F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))
    return assets.filter("variant_group is not null").groupBy("scan_id", "variant_group").agg(
        F.count(F.lit(1)).alias("members"), F.max_by("url", F.struct(area.alias("a"), "url")).alias("largest_url"),
    )


def images_by_page(references: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct (scan, page, image asset): which images each page shows."""
    pairs = references.select("scan_id", "canonical_url", "source_page").distinct()
    images = assets.filter("asset_kind = 'image'").select("scan_id", "canonical_url", "asset_id")
    return pairs.join(images, ["scan_id", "canonical_url"]).select("scan_id", "source_page", "asset_id")


def scan_progress(references: DataFrame, assets: DataFrame, pages: DataFrame, max_pages: int = 100) -> DataFrame:
    """Counters of each scan: pages, references, unique, duplicates, verified, bytes and fraction.

    ``references`` has (scan_id), ``assets`` (scan_id, is_duplicate, verified, bytes_read),
    ``pages`` (scan_id, outcome, bytes, phase).
    """
    r = references.groupBy("scan_id").agg(F.count(F.lit(1)).alias("references"))
    a = assets.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("unique_assets"), F.count_if("is_duplicate").alias("content_duplicates"),
        F.count_if("verified").alias("verified"), F.sum("bytes_read").alias("asset_bytes"),
    )
    p = pages.groupBy("scan_id").agg(
        F.count_if(F.col("outcome") == "ok").alias("pages_scanned"), F.count_if(F.col("outcome") == "error").alias("pages_failed"),
        F.sum("bytes").alias("page_bytes"), F.max(F.col("phase") == "crawling").alias("crawling"),
    )
    df = p.join(a, "scan_id", "full_outer").join(r, "scan_id", "full_outer")
    n = lambda c: F.coalesce(c, F.lit(0))
    page_share = F.least(F.lit(1.0), n("pages_scanned") / F.lit(max(1, max_pages)))
    verify_share = F.least(F.lit(1.0), n("verified") / F.greatest(F.lit(1), n("unique_assets")))
    value = F.when(F.coalesce("crawling", F.lit(False)), page_share * 0.7 + verify_share * 0.2).otherwise(0.9)
    return df.select(
        "scan_id", n("pages_scanned").alias("pages_scanned"), n("pages_failed").alias("pages_failed"),
        n("references").alias("references"), n("unique_assets").alias("unique_assets"),
        (n("content_duplicates") + F.greatest(n("references") - n("unique_assets"), F.lit(0))).alias("duplicates"),
        n("verified").alias("verified"), (n("asset_bytes") + n("page_bytes")).alias("bytes"),
        F.round(F.least(F.lit(0.98), value), 6).alias("fraction"),
    )


def assets_since(assets: DataFrame, since: int = 0, limit: int = 1000, below_minimum: bool = True) -> DataFrame:
    """The next page of each scan's assets after a cursor: at most ``limit`` rows by ``seq``.

    ``seq`` is dense, so the page is a range of it and needs no sort or rank.
    """
    df = assets if below_minimum else assets.filter("not below_minimum")
    df = df.filter(F.col("seq") > since)
    if below_minimum:
        return df.filter(F.col("seq") <= since + limit)
    from pyspark.sql import Window

    scan = Window.partitionBy("scan_id").orderBy("seq")
    return df.withColumn("_n", F.row_number().over(scan)).filter(F.col("_n") <= limit).drop("_n")


def with_asset_ids(references: DataFrame) -> DataFrame:
    """References with the id of their asset, which its scan and canonical URL give: no asset is looked up."""
    return stage(references, asset_id=U.asset_id(F.col("scan_id"), F.col("canonical_url")))


def asset_by_id(assets: DataFrame, references: DataFrame, asset_id: str, scan_id: str | None = None) -> DataFrame:
    """One asset with all its references, inside one scan or across scans."""
    wanted = assets.filter(F.col("asset_id") == asset_id)
    if scan_id is not None:
        wanted = wanted.filter(F.col("scan_id") == scan_id)
    return wanted.join(references, ["scan_id", "canonical_url"])
