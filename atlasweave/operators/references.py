"""References: what each page points at, from element rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import urls as U
from ..functions.labels import lookup
from ..functions.stages import stage
from ..functions.text import clean_text, strip
from ..sources.css import with_css_urls
from ..sources.html import BASE, anchor_elements, attribute, page_markup, tag_elements, tree_elements

# A candidate: a URL the text order of (path_rank, ordinal, sub) places within its page.
_FIELDS = {
    "path_rank": "int", "sub": "int", "source_type": "string", "raw": "string", "descriptor": "string",
    "declared_width": "int", "declared_height": "int", "is_lazy": "boolean", "alt_text": "string",
    "title": "string", "context_hint": "string", "element_path": "string", "geo": "boolean",
}
SRCSET_CANDIDATE = r"([^\s,](?:\S*[^\s,])?)(?:,+|\s+([^,]*),?)?"


def parse_srcset(value: Column) -> Column:
    """Candidates of a ``srcset`` value, tolerant of commas inside URLs."""

    def one(c: Column) -> Column:
        descriptor = F.nullif(strip(F.regexp_extract(c, SRCSET_CANDIDATE, 2)), F.lit(""))
        number = lambda unit: F.nullif(
            F.regexp_extract(descriptor, rf"(?i)^(\d+(?:\.\d+)?){unit}$", 1), F.lit("")
        ).cast("double")
        return F.struct(
            F.regexp_extract(c, SRCSET_CANDIDATE, 1).alias("url"),
            descriptor.alias("descriptor"),
            F.floor(number("w") + 0.5).cast("int").alias("width"),
            number("x").alias("density"),
        )

    return F.transform(F.regexp_extract_all(value, F.lit(SRCSET_CANDIDATE), F.lit(0)), one)


def declared_size(value: Column) -> Column:
    """A positive ``width``/``height`` attribute in whole pixels, else null."""
    digits = F.regexp_extract(strip(value), r"(?i)^(\d+)(px)?$", 1)
    return F.nullif(digits.try_cast("int"), F.lit(0))


def _candidate(**given) -> Column:
    fields = []
    for name, kind in _FIELDS.items():
        value = given.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        fields.append(value.cast(kind).alias(name))
    return F.struct(*fields)


def _listed(names: list[str]) -> Column:
    """The element's attributes among ``names``, in the order of ``names``."""
    order = F.array(*[F.lit(n) for n in names])
    hits = F.filter("attrs", lambda a: a["name"].isin(*names) & (a["value"] != ""))
    return F.array_sort(
        F.transform(hits, lambda a: F.struct(F.array_position(order, a["name"]).alias("i"), a["value"].alias("value")))
    )


_ATTRIBUTES = {
    n: n.replace("-", "_").replace(":", "_")
    for n in (
        "src", "srcset", "alt", "title", "aria-label", "width", "height", "type", "property", "name", "itemprop",
        "content", "rel", "href", "sizes", "poster", "xlink:href", "data",
    )
}


def _read_attributes(elements: DataFrame) -> DataFrame:
    """Stage every attribute the rules look at, so each is found once per element."""
    df = stage(
        elements,
        **{f"a_{c}": attribute(n) for n, c in _ATTRIBUTES.items()},
        lazy_src=_listed(K.LAZY_SRC_ATTRIBUTES),
        lazy_sets=_listed(K.LAZY_SRCSET_ATTRIBUTES),
        geo_attrs=_listed(K.GEO_DATA_ATTRIBUTES),
    )
    lazy_sets = F.flatten(
        F.transform(
            "lazy_sets",
            lambda a: F.transform(
                parse_srcset(a["value"]),
                lambda c, i: F.struct((a["i"] * 100_000 + 10_000_000 + i).cast("int").alias("sub"), c.alias("c")),
            ),
        )
    )
    return stage(
        df,
        alt=clean_text(F.col("a_alt")),
        label=clean_text(F.coalesce("a_alt", "a_aria_label")),
        title=clean_text(F.col("a_title")),
        width=declared_size(F.col("a_width")),
        height=declared_size(F.col("a_height")),
        set_=parse_srcset(F.col("a_srcset")),
        lazy_set_=lazy_sets,
        rel=F.lower(strip(F.col("a_rel"))),
        type=F.lower(F.coalesce("a_type", F.lit(""))),
        meta_name=F.lower(F.coalesce("a_property", "a_name", "a_itemprop")),
    )


def _candidates() -> Column:
    """All candidates of one element, as an array; the position of a rule is its path rank."""
    tag, path, hint = F.col("tag"), F.col("element_path"), F.col("context_hint")
    has = lambda name: F.col(f"a_{name}")
    is_img, is_source = tag == "img", tag == "source"
    none = F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">>")

    def srcset(start: int, width=None, **shared) -> Column:
        return F.transform(
            "set_",
            lambda c, i: _candidate(
                raw=c["url"], descriptor=c["descriptor"], sub=i + start,
                declared_width=c["width"] if width is None else F.coalesce(c["width"], width), **shared,
            ),
        )

    def lazy_lists(sized: bool, width=None, **shared) -> Column:
        def one(e: Column) -> Column:
            own = e["c"]["width"] if width is None else F.coalesce(e["c"]["width"], width)
            return _candidate(
                source_type="lazy-attribute", is_lazy=True, raw=e["c"]["url"], descriptor=e["c"]["descriptor"],
                sub=e["sub"], declared_width=own if sized else F.lit(None), **shared,
            )

        return F.transform("lazy_set_", one)

    def rule(condition: Column, *arrays: Column) -> Column:
        # A missing attribute makes its array null, which must not blank the others.
        return F.when(condition, F.concat(*[F.coalesce(a, none) for a in arrays]))

    width, height = F.col("width"), F.col("height")
    img = dict(path_rank=0, alt_text=F.col("alt"), title=F.col("title"), declared_height=height, element_path=path, context_hint=hint)
    source = dict(path_rank=1, alt_text=F.col("picture_alt"), title=F.col("picture_title"), element_path=path, context_hint=hint)
    other = dict(path_rank=2, alt_text=F.col("label"), title=F.col("title"), element_path=path, context_hint=hint)
    geo = dict(is_lazy=False, geo=True, alt_text=clean_text(F.col("text")), title=F.col("title"), element_path=path, context_hint=hint)
    lazy = lambda a, start, **shared: _candidate(
        source_type="lazy-attribute", is_lazy=True, raw=a["value"], sub=a["i"].cast("int") + start, **shared
    )
    plain = lambda source_type, raw, rank, **more: F.array(
        _candidate(path_rank=rank, sub=0, source_type=source_type, raw=raw, is_lazy=False, **more)
    )
    is_icon = F.arrays_overlap(
        F.array_append(F.split("rel", r"\s+"), F.col("rel")), F.array(*[F.lit(r) for r in K.ICON_RELS])
    )
    sizes = strip(has("sizes"))
    px = lambda g: F.nullif(F.regexp_extract(sizes, r"(?i)^(\d+)x(\d+)$", g), F.lit("")).cast("int")
    css = F.transform(
        "css_urls",
        lambda r, i: _candidate(
            path_rank=F.when(tag == "style", 6).otherwise(5), sub=i, source_type="css-inline", raw=r["url"], is_lazy=False,
            element_path=F.when(tag == "style", "style").otherwise(path),
            context_hint=F.coalesce(r["context"], F.when(tag == "style", "style block").otherwise("inline style")),
        ),
    )
    json_images = F.transform(
        "json_images",
        lambda j, i: _candidate(
            path_rank=7, sub=i, source_type="schema-org", raw=j["url"], context_hint=j["hint"], is_lazy=False,
            element_path='script[type="application/ld+json"]',
        ),
    )
    embed_values = F.filter(
        F.transform(U.query_pairs(F.regexp_extract(has("src"), r"\?([^#]*)", 1)), lambda e: e["v"]),
        lambda v: v.rlike("(?i)^https?://"),
    )
    embeds = F.transform(
        F.concat(F.array(has("src")), embed_values),
        lambda v, i: _candidate(path_rank=40, sub=i, source_type="map-embed", raw=v, **geo),
    )
    meta_source = lookup(F.col("meta_name"), K.META_IMAGE_KEYS)
    link_hint = F.concat(F.lit("link rel="), F.col("rel"))
    rules = [
        rule(
            is_img,
            F.array(_candidate(source_type="img", raw=has("src"), sub=0, declared_width=width, is_lazy=False, **img)),
            srcset(10, width, source_type="srcset", is_lazy=False, **img),
            F.transform("lazy_src", lambda a: lazy(a, 1_000_000, declared_width=width, **img)),
            lazy_lists(True, width, **img),
        ),
        rule(
            is_source & ((F.col("type") == "") | F.col("type").startswith("image/"))
            & (F.col("in_picture") | has("srcset").isNotNull() | has("src").isNotNull()),
            srcset(0, source_type="picture-source", is_lazy=False, **source),
            F.array(_candidate(source_type="picture-source", raw=has("src"), sub=1_000_000, is_lazy=False, **source)),
            lazy_lists(True, **source),
        ),
        rule(
            ~is_img & ~is_source,
            F.transform(F.filter("lazy_src", lambda a: ~a["value"].contains(",")), lambda a: lazy(a, 0, **other)),
            lazy_lists(False, **other),
        ),
        rule(
            (tag == "meta") & meta_source.isNotNull(),
            plain(meta_source, has("content"), 3, context_hint=F.concat(F.lit("meta "), F.col("meta_name"))),
        ),
        rule(
            (tag == "link") & is_icon,
            plain("link-icon", has("href"), 4, declared_width=px(1), declared_height=px(2), context_hint=link_hint,
                  element_path=F.concat(F.lit('link[rel="'), F.col("rel"), F.lit('"]'))),
        ),
        rule((tag == "link") & ~is_icon & (F.col("rel") == "image_src"), plain("meta-other", has("href"), 4, context_hint=link_hint)),
        css,
        json_images,
        rule(tag == "video", plain("video-poster", has("poster"), 8, element_path=path, context_hint="video poster")),
        rule(tag == "image", plain("svg-image", F.coalesce(has("href"), has("xlink_href")), 9, element_path=path, context_hint="svg image")),
        rule((tag == "input") & (has("type") == "image"), plain("input-image", has("src"), 10, alt_text=F.col("alt"), element_path=path)),
        rule((tag == "object") & has("type").startswith("image/"), plain("meta-other", has("data"), 11, element_path=path)),
        rule(tag == "a", F.array(_candidate(path_rank=19, sub=0, source_type="anchor-href", raw=has("href"), **geo))),
        F.transform(
            "geo_attrs",
            lambda a: _candidate(path_rank=a["i"].cast("int") + 20, sub=0, source_type="data-attribute", raw=a["value"], **geo),
        ),
        rule(tag.isin("iframe", "embed") & (has("src") != ""), embeds),
    ]
    return F.concat(*[F.coalesce(r, none) for r in rules])


#: Elements that give references of a type; the others come from attributes of any element.
_TAGS_OF = {
    "img": ["img"], "srcset": ["img"], "picture-source": ["source"], "link-icon": ["link"], "schema-org": ["script"], "video-poster": ["video"],
    "svg-image": ["image"], "input-image": ["input"], "anchor-href": ["a"], "map-embed": ["iframe", "embed"],
    "meta-other": ["meta", "link", "object"], "css-inline": ["style"], **{s: ["meta"] for s in K.META_IMAGE_KEYS.values() if s != "meta-other"},
}
_ATTRIBUTES_OF = {
    "lazy-attribute": K.LAZY_SRC_ATTRIBUTES + K.LAZY_SRCSET_ATTRIBUTES, "data-attribute": K.GEO_DATA_ATTRIBUTES, "css-inline": ["style"],
}


def tags_of(sources: list[str]) -> str:
    """A pattern found in every start tag that can give references of these types."""
    tags = sorted({t for s in sources for t in _TAGS_OF.get(s, [])})
    named = [f"^<(?:{'|'.join(tags)})[\\s/>]"] if tags else []
    return "(?iu)" + "|".join([*named, *sorted({a for s in sources for a in _ATTRIBUTES_OF.get(s, [])})])


def references(
    elements: DataFrame, max_per_page: int | None = None, max_css_urls: int | None = None, sources: list[str] | None = None
) -> DataFrame:
    """All references of element rows, resolved, unique per page, in page order.

    Image references are keyed by (source type, URL, descriptor), geographic ones by (source
    type, URL). All are kept unless ``max_per_page`` image references of a page, in order,
    ``max_css_urls`` of one style or only those of some ``sources`` (types) are asked for.
    """
    if sources is None or "css-inline" in sources or max_per_page is not None:
        style = attribute("style")
        df = stage(elements, _css=F.when(F.col("tag") == "style", F.col("text")).when(style.contains("url("), style))
        df = with_css_urls(df, "_css", "css_urls", max_css_urls)
    else:
        df = elements.withColumn("css_urls", F.array().cast("array<struct<url:string,context:string>>"))
    df = _read_attributes(df).select(*BASE, "ordinal", F.inline(_candidates()))
    if sources is not None and max_per_page is None:
        df = df.filter(F.col("source_type").isin(*sources))
    df = df.filter(U.is_fetchable(F.col("raw")))
    df = U.with_resolved(df, "raw", "base_url", "resolved_url", parsed="base").filter("resolved_url is not null")
    df = df.withColumn("geo", F.coalesce("geo", F.lit(False)))
    # Only geographic references are told by their file name.
    df = U.with_filename(df.withColumn("_geo_url", F.when(F.col("geo"), F.col("resolved_url"))), "_geo_url", "_name")
    df = df.filter(~F.col("geo") | U.geo_format(F.col("_name")).isNotNull()).drop("_name", "_geo_url")
    order = ["path_rank", "ordinal", "sub"]
    key = Window.partitionBy("page_id", "geo", "source_type", "resolved_url", F.coalesce("descriptor", F.lit(""))).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(key)).filter("_n = 1")
    if max_per_page is not None:
        page = Window.partitionBy("page_id", "geo").orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(page)).filter(F.col("geo") | (F.col("_rank") <= max_per_page))
        df = df if sources is None else df.filter(F.col("source_type").isin(*sources))
    return df.select(
        "page_id", F.col("url").alias("source_page"), "path_rank", "ordinal", "sub", "source_type",
        strip(F.col("raw")).alias("original_url"), "resolved_url", "descriptor", "declared_width", "declared_height",
        "is_lazy", "alt_text", "title", "element_path", "context_hint", "geo",
    )


def extract_references(pages: DataFrame) -> DataFrame:
    """Whole-page extraction, with element paths and context hints."""
    return references(tree_elements(pages))


def scan_references(pages: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """The same references from the JVM-side tag scan: no element path, context or JSON-LD. All, or those of some ``sources``
    (types): then no other tag is read further than its name."""
    return references(tag_elements(pages, None if sources is None else tags_of(sources)), sources=sources)


def geo_anchors(pages: DataFrame) -> DataFrame:
    """Links to geographic files with their link text, unique per page and URL."""
    a = stage(anchor_elements(pages), href=attribute("href"), title=clean_text(attribute("title")))
    a = U.with_resolved(a.filter(F.col("href").isNotNull()), "href", "base_url", "resolved_url", parsed="base")
    a = U.with_filename(a.filter("resolved_url is not null"), "resolved_url", "_name")
    a = stage(a, geo_format=U.geo_format(F.col("_name"))).filter("geo_format is not null")
    first = Window.partitionBy("page_id", "resolved_url").orderBy("ordinal")
    a = a.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return a.select("page_id", F.col("url").alias("source_page"), "ordinal", "resolved_url", "geo_format",
                    F.col("text").alias("alt_text"), "title")


def _page_hrefs(pages: DataFrame, tag: str) -> DataFrame:
    rows = tag_elements(pages).filter(F.col("tag") == tag)
    return stage(rows, href=attribute("href"), rel=F.lower(F.coalesce(attribute("rel"), F.lit("")))).select(
        *BASE, "ordinal", "href", "rel"
    )


def page_links(pages: DataFrame, max_links: int | None = None) -> DataFrame:
    """Followable, page-like link targets, unique and ranked per page; all, or the first ``max_links`` of a page."""
    a = _page_hrefs(pages, "a").filter(~F.col("rel").contains("nofollow") & F.col("href").isNotNull())
    a = U.with_resolved(a, "href", "base_url", "link", parsed="base").filter("link is not null")
    a = U.with_url_parts(a, F.col("link"), "_k")
    a = a.filter(U.page_like(F.col("_k_path")))
    a = a.groupBy("page_id", "url", "link").agg(F.min("ordinal").alias("ordinal"))
    page = Window.partitionBy("page_id").orderBy("ordinal")
    ranked = a.withColumn("rank", F.row_number().over(page))
    return ranked if max_links is None else ranked.filter(F.col("rank") <= max_links)


def page_stylesheets(pages: DataFrame) -> DataFrame:
    """Distinct style sheet URLs per page."""
    s = _page_hrefs(pages, "link").filter(
        F.array_contains(F.split(strip(F.col("rel")), r"\s+"), "stylesheet") & F.col("href").isNotNull()
    )
    s = U.with_resolved(s, "href", "base_url", "stylesheet_url", parsed="base").filter("stylesheet_url is not null")
    return s.groupBy("page_id", "url", "stylesheet_url").agg(F.min("ordinal").alias("ordinal"))


def page_meta(pages: DataFrame) -> DataFrame:
    """Base URL, title and no-follow flag of each page."""
    robots = F.filter("tags", lambda t: t.rlike(r"""(?i)^<meta\s[^>]*name\s*=\s*["']?robots["'\s/>]"""))
    content = F.lower(F.regexp_extract(F.get(robots, 0), r"""(?i)content\s*=\s*["']?([^"'>]*)""", 1))
    return page_markup(pages).select(
        "page_id", "url", "base_url", "title",
        F.coalesce(content.contains("nofollow") | content.contains("none"), F.lit(False)).alias("meta_nofollow"),
    )


def page_reference_counts(references_: DataFrame) -> DataFrame:
    """Image references per page; geographic ones are not counted."""
    return references_.groupBy("page_id").agg(F.count_if(~F.col("geo")).alias("image_refs"))


def stylesheet_references(sheets_of_pages: DataFrame, stylesheets: DataFrame, max_sheets: int | None = None, max_urls: int | None = None) -> DataFrame:
    """References in same-site style sheets, each sheet once per scan: all, or the first ``max_sheets`` and ``max_urls`` of each.

    ``sheets_of_pages`` has (scan_id, page_id, url, stylesheet_url, ordinal), ``stylesheets``
    has (url, css).
    """
    s = U.with_url_parts(sheets_of_pages, F.col("url"), "_p")
    s = U.with_url_parts(s, F.col("stylesheet_url"), "_s")
    s = s.filter(U.same_site(F.col("_s_host"), F.col("_p_host"), True))
    s = s.groupBy("scan_id", "stylesheet_url").agg(
        F.min_by("url", F.struct("page_id", "ordinal")).alias("source_page"),
        F.min(F.struct("page_id", "ordinal")).alias("seen"),
    )
    if max_sheets is not None:
        scan = Window.partitionBy("scan_id").orderBy("seen")
        s = s.withColumn("_n", F.row_number().over(scan)).filter(F.col("_n") <= max_sheets)
    css = s.join(stylesheets.select(F.col("url").alias("stylesheet_url"), "css"), "stylesheet_url")
    css = with_css_urls(css, "css", "found", max_urls)
    css = css.select("scan_id", "source_page", "stylesheet_url", F.posexplode("found").alias("ordinal", "f"))
    css = css.select("*", F.col("f.url").alias("original_url"), F.col("f.context").alias("element_path")).drop("f")
    css = U.with_resolved(css, "original_url", "stylesheet_url", "resolved_url").filter("resolved_url is not null")
    css = U.with_filename(css, "stylesheet_url", "_sheet")
    return css.withColumn("source_type", F.lit("css-stylesheet")).withColumn(
        "context_hint",
        F.concat(F.lit("stylesheet "), F.concat_ws(" | ", "_sheet", "element_path")),
    ).drop("_sheet")


def consolidate_links(pages: DataFrame) -> DataFrame:
    """Links consolidated into unique canonical pages: how often and from where each is linked."""
    links = U.with_canonical(page_links(pages), "link", "canonical_url", page=True)
    # Per (target, page) first, so a target linked from every page is combined before the shuffle.
    per_page = links.groupBy("canonical_url", "page_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", "link")).alias("first")
    )
    return per_page.groupBy("canonical_url").agg(
        F.sum("n").alias("reference_count"),
        F.count(F.lit(1)).alias("page_count"),
        F.min_by("first.link", F.struct("page_id", "first.ordinal")).alias("first_link"),
        F.min("page_id").alias("first_page_id"),
    )
