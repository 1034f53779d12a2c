"""Reference extraction over pages: flat discovery paths, tree columns, links and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.stages import stage
from ..operators import references as R
from ..sources.css import css_imports, with_css_urls
from ..views import view, with_views
from . import duck as D
from .registry import query

# What the v_html pages hold, stated directly from the part table.
_HTML = """(SELECT p_partkey AS page_id, p_size AS size, p_name AS name, 'https://www.site' || p_partkey % 7 || '.example.org' AS site,
 'https://www.site' || p_partkey % 7 || '.example.org' || CASE WHEN p_size % 5 = 0 THEN '/base/' ELSE '/maps/' || p_partkey || '/' END AS dir,
 'https://www.site' || p_partkey % 7 || '.example.org' || CASE WHEN p_size % 5 = 0 THEN '/' ELSE '/maps/' END AS up FROM part)"""
_TREE = "(SELECT p_partkey AS page_id, p_size AS size, p_name AS name, 'https://www.site' || p_partkey % 7 || '.example.org' AS site FROM part)"


def _slice(spark, sf, *sources, geo=False):
    return R.scan_references(view(spark, sf, "v_html"), list(sources)).filter(F.col("geo") == geo)


@query("refs_img_src", f"SELECT page_id, dir || 'img/p-' || page_id || '.png' AS resolved_url, 'img/p-' || page_id || '.png' AS original_url, 'Survey ' || size AS alt_text, CAST(size AS INTEGER) AS declared_width, CAST(NULL AS INTEGER) AS declared_height FROM {_HTML}")
def refs_img_src(spark, sf):
    return _slice(spark, sf, "img").select("page_id", "resolved_url", "original_url", "alt_text", "declared_width", "declared_height")


@query("refs_srcset", f"""
SELECT page_id, site || '/a-320.jpg' AS resolved_url, '320w' AS descriptor, 320 AS declared_width FROM {_HTML}
UNION ALL SELECT page_id, 'https://cdn.example.net/x,y/a@2x.png', '2x', NULL FROM {_HTML} UNION ALL SELECT page_id, site || '/plain.jpg', NULL, NULL FROM {_HTML}""")
def refs_srcset(spark, sf):
    return _slice(spark, sf, "srcset").select("page_id", "resolved_url", "descriptor", "declared_width")


@query("refs_lazy_img", f"SELECT page_id, up || 'lazy-' || size || '.png' AS resolved_url, TRUE AS is_lazy FROM {_HTML}")
def refs_lazy_img(spark, sf):
    return _slice(spark, sf, "lazy-attribute").filter("path_rank = 0").select("page_id", "resolved_url", "is_lazy")


@query("refs_lazy_other", f"SELECT page_id, site || '/img/bg.png' AS resolved_url, 'widget' AS alt_text FROM {_HTML}")
def refs_lazy_other(spark, sf):
    return _slice(spark, sf, "lazy-attribute").filter("path_rank = 2").select("page_id", "resolved_url", "alt_text")


@query("refs_meta_social", f"SELECT page_id, site || '/img/og-' || size || '.png' AS resolved_url, 'og-image' AS source_type, 'meta og:image' AS context_hint FROM {_HTML}")
def refs_meta_social(spark, sf):
    return _slice(spark, sf, "og-image", "twitter-image").select("page_id", "resolved_url", "source_type", "context_hint")


@query("refs_link_icons", f"SELECT page_id, site || '/favicon.ico' AS resolved_url, 32 AS declared_width, 32 AS declared_height, 'link[rel=\"shortcut icon\"]' AS element_path FROM {_HTML}")
def refs_link_icons(spark, sf):
    return _slice(spark, sf, "link-icon").select("page_id", "resolved_url", "declared_width", "declared_height", "element_path")


@query("refs_image_src", f"SELECT page_id, site || '/img/src.png' AS resolved_url FROM {_HTML}")
def refs_image_src(spark, sf):
    return _slice(spark, sf, "meta-other").filter("path_rank = 4").select("page_id", "resolved_url")


@query("refs_css", f"""
SELECT page_id, site || '/img/inline-' || size || '.png' AS resolved_url, 'background' AS context_hint FROM {_HTML}
UNION ALL SELECT page_id, site || '/img/tex-' || size || '.png', 'background-image .t' FROM {_HTML}
UNION ALL SELECT page_id, site || '/css/more-' || size || '.css', 'style block' FROM {_HTML}""")
def refs_css(spark, sf):
    return _slice(spark, sf, "css-inline").select("page_id", "resolved_url", "context_hint")


@query("refs_embedded_media", f"""
SELECT page_id, site || '/img/poster.png' AS resolved_url, 'video-poster' AS source_type FROM {_HTML} UNION ALL SELECT page_id, site || '/img/vector.svg', 'svg-image' FROM {_HTML}
UNION ALL SELECT page_id, site || '/img/go.png', 'input-image' FROM {_HTML} UNION ALL SELECT page_id, site || '/img/object.png', 'meta-other' FROM {_HTML}""")
def refs_embedded_media(spark, sf):
    df = _slice(spark, sf, "video-poster", "svg-image", "input-image", "meta-other").filter("path_rank >= 8")
    return df.select("page_id", "resolved_url", "source_type")


@query("geo_refs_anchor", f"SELECT page_id, site || '/data/b-shp.zip' AS resolved_url, 'shapefile-zip' AS geo_format, 'Shapes' AS alt_text FROM {_HTML}")
def geo_refs_anchor(spark, sf):
    return R.geo_anchors(view(spark, sf, "v_html")).select("page_id", "resolved_url", "geo_format", "alt_text")


@query("geo_refs_data_attr", f"SELECT page_id, site || '/data/v-' || size || '.kml' AS resolved_url FROM {_HTML}")
def geo_refs_data_attr(spark, sf):
    return _slice(spark, sf, "data-attribute", geo=True).select("page_id", "resolved_url")


@query("geo_refs_map_embed", f"SELECT page_id, 'https://data.example.net/l.kmz' AS resolved_url FROM {_HTML}")
def geo_refs_map_embed(spark, sf):
    return _slice(spark, sf, "map-embed", geo=True).select("page_id", "resolved_url")


@query("page_links", f"SELECT page_id, link, CAST(rank AS INTEGER) AS rank FROM {D.page_links()}")
def page_links(spark, sf):
    return R.page_links(view(spark, sf, "pages")).select("page_id", "link", "rank")


@query("page_stylesheets", f"SELECT page_id, site || '/css/site.css' AS stylesheet_url FROM {_HTML}")
def page_stylesheets(spark, sf):
    return R.page_stylesheets(view(spark, sf, "v_html")).select("page_id", "stylesheet_url")


@query("page_base_url", f"SELECT page_id, CASE WHEN size % 5 = 0 THEN dir ELSE dir || 'index.html' END AS base_url FROM {_HTML}")
def page_base_url(spark, sf):
    return R.page_meta(view(spark, sf, "v_html")).select("page_id", "base_url")


@query("page_titles", f"SELECT page_id, {D.clean(D.entities('regexp_extract(regexp_replace(html, ' + D.q(D.NON_MARKUP) + ', ' + D.q('') + ', ' + D.q('g') + '), ' + D.q('(?is)<title[^>]*>(.*?)</title') + ', 1)'))} AS title FROM pages")
def page_titles(spark, sf):
    return R.page_meta(view(spark, sf, "pages")).select("page_id", "title")


@query("page_nofollow", f"SELECT page_id, size % 6 = 0 AS meta_nofollow FROM {_HTML}")
def page_nofollow(spark, sf):
    return R.page_meta(view(spark, sf, "v_html")).select("page_id", "meta_nofollow")


@query("ref_dimensions", f"SELECT page_id, source_type, CAST(w AS INTEGER) AS declared_width, CAST(NULL AS INTEGER) AS declared_height FROM (SELECT page_id, 'img' AS source_type, size AS w FROM {_HTML} UNION ALL SELECT page_id, 'srcset', 320 FROM {_HTML})")
def ref_dimensions(spark, sf):
    df = _slice(spark, sf, "img", "srcset").filter("declared_width is not null")
    return df.select("page_id", "source_type", "declared_width", "declared_height")


@query("page_ref_counts", f"SELECT page_id, CAST(16 AS BIGINT) AS image_refs FROM {_HTML}")
def page_ref_counts(spark, sf):
    return R.page_reference_counts(R.scan_references(view(spark, sf, "v_html")))


@query("css_imports", with_views("v_html") + f"SELECT page_id, '/css/more-' || p_size || '.css' AS import_url FROM v_html JOIN part ON p_partkey = page_id")
def css_import_targets(spark, sf):
    from ..sources.html import page_markup

    css = page_markup(view(spark, sf, "v_html")).select("page_id", F.explode("styles").alias("css"))
    return css.select("page_id", F.explode(css_imports(F.col("css"))).alias("import_url"))


@query("stylesheet_refs", """
SELECT 'https://www.site' || s || '.example.org/css/site.css' AS stylesheet_url, source_page, 'https://www.site' || s || '.example.org/img/sheet-' || s || '.png' AS resolved_url,
 'stylesheet site.css | background /* c */ .hero' AS context_hint
FROM (SELECT p_partkey % 7 AS s, 'https://www.site' || p_partkey % 7 || '.example.org/maps/' || min(p_partkey) || '/index.html' AS source_page FROM part GROUP BY p_partkey % 7)""")
def stylesheet_refs(spark, sf):
    pages = view(spark, sf, "v_html")
    sheets = R.page_stylesheets(pages).withColumn("scan_id", F.lit("all"))
    css = sheets.select(F.col("stylesheet_url").alias("url")).distinct()
    site = F.regexp_extract("url", r"site(\d+)", 1)
    css = css.withColumn("css", F.concat(F.lit("/* c */ .hero { background: url('../img/sheet-"), site, F.lit(".png') } .x { color: red; src: url(#frag) }")))
    return R.stylesheet_references(sheets, css).select("stylesheet_url", "source_page", "resolved_url", "context_hint")


_SECTION = "'section | Sheet ' || size"
_TREE_REFS = f"""
SELECT page_id, 'img' AS source_type, site || '/img/' || page_id || '.png' AS resolved_url, NULL AS descriptor, NULL AS alt_text, 'figure.fig > a > img.shot' AS element_path,
 'Plan of ' || name || ' | /full/' || page_id || ' | ' || {_SECTION} AS context_hint FROM {_TREE}
UNION ALL SELECT page_id, 'img', site || '/pic/base.jpg', NULL, 'Picture ' || size, 'section.plan > picture > img', {_SECTION} FROM {_TREE}
UNION ALL SELECT page_id, 'picture-source', site || '/pic/' || size || '.webp', '800w', 'Picture ' || size, 'section.plan > picture > source', {_SECTION} FROM {_TREE}
UNION ALL SELECT page_id, 'schema-org', site || '/ld/a-' || size || '.jpg', NULL, NULL, 'script[type="application/ld+json"]', 'json-ld Article' FROM {_TREE}
UNION ALL SELECT page_id, 'schema-org', site || '/ld/logo.png', NULL, NULL, 'script[type="application/ld+json"]', 'json-ld ImageObject' FROM {_TREE}"""
_REF_COLUMNS = ("page_id", "source_type", "resolved_url", "descriptor", "alt_text", "element_path", "context_hint")


@query("extract_references", f"SELECT * FROM ({_TREE_REFS})")
def extract_references(spark, sf):
    return R.extract_references(view(spark, sf, "v_tree")).select(*_REF_COLUMNS)


@query("refs_picture_source", f"SELECT page_id, resolved_url, descriptor, alt_text FROM ({_TREE_REFS}) WHERE source_type = 'picture-source'")
def refs_picture_source(spark, sf):
    df = R.extract_references(view(spark, sf, "v_tree")).filter("source_type = 'picture-source'")
    return df.select("page_id", "resolved_url", "descriptor", "alt_text")


@query("refs_jsonld", f"SELECT page_id, resolved_url, context_hint FROM ({_TREE_REFS}) WHERE source_type = 'schema-org'")
def refs_jsonld(spark, sf):
    df = R.extract_references(view(spark, sf, "v_tree")).filter("source_type = 'schema-org'")
    return df.select("page_id", "resolved_url", "context_hint")


@query("element_paths", f"SELECT page_id, resolved_url, element_path FROM ({_TREE_REFS}) WHERE source_type <> 'schema-org'")
def element_paths(spark, sf):
    df = R.extract_references(view(spark, sf, "v_tree")).filter("source_type <> 'schema-org'")
    return df.select("page_id", "resolved_url", "element_path")


@query("context_hints", f"SELECT page_id, resolved_url, context_hint FROM ({_TREE_REFS}) WHERE source_type <> 'schema-org'")
def context_hints(spark, sf):
    df = R.extract_references(view(spark, sf, "v_tree")).filter("source_type <> 'schema-org'")
    return df.select("page_id", "resolved_url", "context_hint")


@query("parse_srcset", f"""
SELECT page_id, 0 AS pos, '/a-320.jpg' AS url, '320w' AS descriptor, 320 AS width, CAST(NULL AS DOUBLE) AS density FROM {_HTML}
UNION ALL SELECT page_id, 1, 'https://cdn.example.net/x,y/a@2x.png', '2x', NULL, 2.0 FROM {_HTML} UNION ALL SELECT page_id, 2, '/plain.jpg', NULL, NULL, NULL FROM {_HTML}""")
def parse_srcset(spark, sf):
    from ..sources.html import attribute, tag_elements

    sets = stage(tag_elements(view(spark, sf, "v_html")), value=attribute("srcset")).filter("value is not null")
    return sets.select("page_id", F.posexplode(R.parse_srcset(F.col("value"))).alias("pos", "c")).select("page_id", "pos", "c.*")


@query("css_urls_of_pages", """
SELECT page_id, '/img/tex-' || p_size || '.png' AS css_url, 'background-image .t' AS context FROM (SELECT p_partkey AS page_id, p_size FROM part)
UNION ALL SELECT p_partkey, '/css/more-' || p_size || '.css', NULL FROM part""")
def css_urls_of_pages(spark, sf):
    from ..sources.html import page_markup

    css = page_markup(view(spark, sf, "v_html")).select("page_id", F.explode("styles").alias("css"))
    css = with_css_urls(css, "css", "found")
    return css.select("page_id", F.inline("found")).withColumnRenamed("url", "css_url")


@query("consolidate_links", f"""
SELECT canonical_url, count(*) AS reference_count, count(DISTINCT page_id) AS page_count, arg_min(link, [page_id, ordinal]) AS first_link, min(page_id) AS first_page_id
FROM {D.canonical(D.page_links(), 'link', 'canonical_url', True)} GROUP BY canonical_url""")
def consolidate_links(spark, sf):
    return R.consolidate_links(view(spark, sf, "pages"))
