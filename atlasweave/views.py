"""Input views over the given tables, in the SQL both Spark and DuckDB accept.

Each view shapes whole tables into the inputs the operators need (references, responses,
page HTML, features, coordinates ...). Keys are derived from table keys, so the number of
assets, pages, maps and parcels grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


_REF_PAGE = _div("l_orderkey", 10)
_REF_PIC = _div("l_partkey", 10)
_MAP = _div("c_custkey", 25)

VIEWS = {
    # references as extracted: total order (page_seq, path_rank, ordinal, original_url)
    "v_refs": f"""
SELECT {_s('l_suppkey % 5')} AS scan_id,
       l_orderkey AS page_seq, CAST(l_linenumber AS BIGINT) AS path_rank, l_partkey * 1000 + l_suppkey AS ordinal,
       'https://site' || {_s(_REF_PAGE + ' % 20')} || '.example.co.in/maps/p-' || {_s(_REF_PAGE)} AS source_page,
       CASE l_linenumber WHEN 1 THEN 'img' WHEN 2 THEN 'srcset' WHEN 3 THEN 'lazy-attribute' WHEN 4 THEN 'og-image' WHEN 5 THEN 'css-inline' WHEN 6 THEN 'link-icon' ELSE 'picture-source' END AS source_type,
       'https://IMG' || {_s('l_suppkey % 3')} || '.example.co.in:443//' || CASE {_REF_PIC} % 4 WHEN 0 THEN 'maps' WHEN 1 THEN 'icons' WHEN 2 THEN 'photos' ELSE 'data' END
         || '/survey-' || {_s(_REF_PIC)} || CASE l_linenumber WHEN 2 THEN '-300x200' WHEN 3 THEN '@2x' ELSE '' END
         || CASE {_REF_PIC} % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.ico' WHEN 2 THEN '.jpeg' ELSE '.kml' END
         || CASE l_linenumber WHEN 1 THEN '?utm_source=n&b=2&a=1&v=9' WHEN 4 THEN '?a=1&b=2#top' WHEN 5 THEN '?w=300' ELSE '' END AS original_url,
       CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 'Survey 125/2 sheet' ELSE 'Town plan ' || {_s(_REF_PIC)} END AS alt_text,
       CASE WHEN l_partkey % 11 = 0 THEN 'Sheet ' || l_returnflag END AS title,
       CASE WHEN l_linenumber = 2 THEN {_s('CAST(100 + l_quantity AS BIGINT)')} || 'w' END AS descriptor,
       CASE WHEN l_linenumber = 2 THEN CAST(100 + l_quantity AS INT) END AS declared_width,
       'main > img.' || l_returnflag AS element_path,
       l_linenumber = 3 AS is_lazy
FROM lineitem""",
    # verification responses; a null status means the request failed
    "v_responses": f"""
SELECT p_partkey AS seq, 'img_' || {_s('p_partkey')} AS asset_id, {_s('p_partkey % 5')} AS scan_id,
       'https://img.example.co.in/maps/' || replace(p_name, ' ', '-') || '-' || {_s('p_partkey')} || CASE p_partkey % 5 WHEN 0 THEN '.svg' WHEN 1 THEN '.kml' ELSE '.png' END AS url,
       CASE WHEN p_partkey % 5 = 1 THEN 'geo' ELSE 'image' END AS asset_kind,
       CASE p_size % 11 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN NULL ELSE 200 END AS http_status,
       CASE WHEN p_size % 13 = 0 THEN 'text/html; charset=utf-8' WHEN p_partkey % 5 = 0 THEN 'image/svg+xml' WHEN p_partkey % 5 = 1 THEN 'text/xml' WHEN p_size % 7 = 0 THEN NULL ELSE 'Image/PNG' END AS content_type,
       CASE WHEN p_size % 9 = 0 THEN TRUE ELSE FALSE END AS redirected,
       CASE WHEN p_size % 17 = 0 THEN TRUE ELSE FALSE END AS truncated,
       p_size * 40 AS width, CAST((p_partkey % 50) * 30 AS INT) AS height,
       CASE WHEN p_size % 17 = 0 THEN NULL ELSE p_brand || p_type END AS body_text
FROM part""",
    # magic bytes and image headers
    "v_bodies": f"""
SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'kmz' ELSE 'geojson' END AS kind,
       p_size % 17 = 0 AS truncated,
       unhex(CASE p_partkey % 3
         WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || lpad(hex(p_size * 40), 8, '0') || lpad(hex(p_partkey % 900 + 1), 8, '0') || '0806000000'
         WHEN 1 THEN CASE WHEN p_size % 4 = 0 THEN '3C68746D6C3E' ELSE '504B0304140000000000' END
         ELSE CASE WHEN p_size % 4 = 0 THEN '6E6F' ELSE '7B2274797065223A2246227D' END END) AS body
FROM part""",
    # image bodies by kind: JPEG with plain and with awkward segments, SVG roots, WebP, ICO, and cut ones
    "v_images": f"""
SELECT p_partkey AS seq, CAST(p_partkey % 9 AS INT) AS kind, CAST(p_size * 37 AS INT) AS w, CAST(p_partkey % 3000 + 1 AS INT) AS h,
  CASE WHEN p_partkey % 9 IN (3, 4, 5) THEN CAST(CASE p_partkey % 9
    WHEN 3 THEN '<?xml version="1.0"?><!DOCTYPE svg PUBLIC "a" "b"><svg xmlns="x" data-t="a > b" width="' || {_s('p_size * 37')} || 'px" height=' || chr(39) || {_s('p_partkey % 3000 + 1')} || 'pt' || chr(39) || '/>'
    WHEN 4 THEN '<!-- <svg width="1" height="1"> --> <svg:svg viewBox="0 0 ' || {_s('p_size * 37')} || ', ' || {_s('p_partkey % 3000 + 1')} || '" width="50%" height="' || {_s('2 * (p_partkey % 3000 + 1)')} || '"><rect width="3"/></svg:svg>'
    ELSE '<svg width="' || {_s('p_size')} || '" height="10" title="' END AS BINARY)
  ELSE unhex(CASE p_partkey % 9
    WHEN 0 THEN 'FFD8FFE000104A46494600010100000100010000FFDB0004AABBFFC0001108' || lpad(hex(p_partkey % 3000 + 1), 4, '0') || lpad(hex(p_size * 37), 4, '0') || '03012200'
    WHEN 1 THEN 'FFD8FFE1001AFFC000110800010001FFFFDAFFD9FFFF000000000000FFFFFFFE0003FFFFC2001108' || lpad(hex(p_partkey % 3000 + 1), 4, '0') || lpad(hex(p_size * 37), 4, '0') || '0301'
    WHEN 2 THEN 'FFD8FFE000104A46494600010100000100010000FFDB0004AABBFFC0001108' || lpad(hex(p_size), 4, '0')
    WHEN 6 THEN '5249464600000000574542505650385810000000' || '00000000' || hex(p_partkey % 200 + 16) || '0100' || hex(p_size + 16) || '0000'
    WHEN 7 THEN '00000100010010' || hex(p_size + 16) || '00000000000000000000'
    ELSE 'FFD8FFE00010' || '4A46494600010100000100010000' || 'FFDA0008FFC0001108' || '00100010' || 'FFC0001108' || '00100010' END) END AS body
FROM part""",
    # pages covering the flat discovery paths
    "v_html": f"""
SELECT p_partkey AS page_id, 'https://www.site' || {_s('p_partkey % 7')} || '.example.org/maps/' || {_s('p_partkey')} || '/index.html' AS url,
  '<!doctype html><html><head><title> Plan  ' || p_name || ' </title>' || CASE WHEN p_size % 5 = 0 THEN '<base href="/base/">' ELSE '' END
  || '<meta property="og:image" content="/img/og-' || {_s('p_size')} || '.png"><meta name="robots" content="' || CASE WHEN p_size % 6 = 0 THEN 'noindex, nofollow' ELSE 'index' END || '">'
  || '<link rel="shortcut icon" sizes="32x32" href="/favicon.ico"><link rel="stylesheet" href="/css/site.css"><link rel="image_src" href="/img/src.png">'
  || '<style>@import url("/css/more-' || {_s('p_size')} || '.css"); .t{{background-image:url("/img/tex-' || {_s('p_size')} || '.png")}} .d{{background:url(data:image/gif;base64,R0)}}</style></head><body>'
  || '<!-- <img src="/img/commented.png"> --><img src="img/p-' || {_s('p_partkey')} || '.png" alt="Survey ' || {_s('p_size')} || '" width="' || {_s('p_size')} || 'px" height="0">'
  || '<img srcset="/a-320.jpg 320w , https://cdn.example.net/x,y/a@2x.png 2x , /plain.jpg" data-src="../lazy-' || {_s('p_size')} || '.png">'
  || '<div data-bg="/img/bg.png" data-kml="/data/v-' || {_s('p_size')} || '.kml" aria-label="widget" style="background:url(/img/inline-' || {_s('p_size')} || '.png)"></div><video poster="/img/poster.png"></video>'
  || '<svg><image href="/img/vector.svg"></image></svg><input type="image" src="/img/go.png" alt="Go"><object type="image/png" data="/img/object.png"></object>'
  || '<a href="/data/b-shp.zip">Shapes</a><a href="/about/?utm_source=x">About</a><a rel="nofollow" href="/hidden">Hidden</a><a href="/brochure.pdf">PDF</a>'
  || '<iframe src="https://viewer.example.net/?layer=https%3A%2F%2Fdata.example.net%2Fl.kmz&z=3"></iframe></body></html>' AS html
FROM part""",
    # pages whose references need the element tree: figure, picture, section, JSON-LD
    "v_tree": f"""
SELECT p_partkey AS page_id, 'https://www.site' || {_s('p_partkey % 7')} || '.example.org/plans/' || {_s('p_partkey')} AS url, p_name AS name, p_size AS size,
  '<html><head><title>' || p_name || '</title><script type="application/ld+json">{{"@type":"Article","image":["/ld/a-' || {_s('p_size')} || '.jpg"],"publisher":{{"@type":"Organization","logo":{{"@type":"ImageObject","url":"/ld/logo.png"}}}},"note":"not-an-image.txt"}}</script></head><body>'
  || '<main id="content"><section class="plan sheet"><h2>Sheet ' || {_s('p_size')} || '</h2><figure class="fig wide"><a href="/full/' || {_s('p_partkey')} || '"><img src="/img/' || {_s('p_partkey')} || '.png" class="shot large"></a><figcaption>Plan of ' || p_name || '</figcaption></figure>'
  || '<picture><source type="image/webp" srcset="/pic/' || {_s('p_size')} || '.webp 800w"><source type="video/mp4" src="/pic/clip.mp4"><img src="/pic/base.jpg" alt="Picture ' || {_s('p_size')} || '"></picture></section></main></body></html>' AS html
FROM part""",
    # parsed features; a Polygon is the closed square of side d at (lon0, lat0)
    "v_features": f"""
SELECT c_custkey AS ord, 'https://data.example.org/f' || {_s(_MAP)} || '.kml' AS map_url,
       'https://site' || {_s(_MAP + ' % 20')} || '.example.co.in/maps/p-' || {_s(_MAP)} AS source_page,
       CASE c_custkey % 6 WHEN 0 THEN 'Survey No. ' || {_s('c_custkey % 300')} || '/' || {_s('c_custkey % 7')} WHEN 1 THEN 'S.No ' || {_s('c_custkey % 90')} || '/A' WHEN 2 THEN 'Final Plot ' || {_s('c_custkey % 50')} WHEN 3 THEN '125/2' WHEN 4 THEN NULL ELSE 'An ordinary title' END AS name,
       CASE WHEN c_custkey % 8 = 0 THEN {_s('c_custkey')} || '/1' END AS prop_survey_no,
       CASE WHEN c_custkey % 4 < 3 THEN c_mktsegment || ' ' || {_s(_div('c_custkey', 50))} END AS prop_village, CASE WHEN c_custkey % 4 < 3 THEN n_name END AS prop_district, CASE WHEN c_custkey % 4 < 2 THEN r_name END AS prop_state,
       CASE c_custkey % 5 WHEN 0 THEN 'area_hectares' WHEN 1 THEN 'Area (acre)' WHEN 2 THEN 'area_sqm' WHEN 3 THEN 'area' END AS prop_area_key,
       CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE {_s('c_custkey % 37')} || '.5' END AS prop_area_text,
       r_name || ' District' AS document_name, CASE WHEN c_custkey % 16 <> 3 THEN n_name END AS folder_1,
       CASE c_custkey % 5 WHEN 4 THEN 'Point' WHEN 3 THEN 'LineString' ELSE 'Polygon' END AS geometry_type,
       CAST(70 + (c_custkey % 1000) / 100.0 AS DOUBLE) AS lon0, CAST(20 + (c_custkey % 700) / 100.0 AS DOUBLE) AS lat0, CAST(0.001 * (1 + c_custkey % 5) AS DOUBLE) AS d
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # ground overlays, several per map file
    "v_overlays": f"""
SELECT map_url, href, min(ord) AS ord, min(west) AS west, min(west) + 1.0 AS east, CAST(20 AS DOUBLE) AS south, CAST(21 AS DOUBLE) AS north FROM (
SELECT 'https://data.example.org/f' || {_s(_MAP)} || '.kml' AS map_url, c_custkey AS ord,
       CASE WHEN c_custkey % 2 = 0 THEN 'https://img0.example.co.in//maps/survey-' ELSE 'maps/survey-' END || {_s('4 * (c_custkey % 50)')} || '.png' AS href,
       CAST(70 + c_custkey % 40 AS DOUBLE) AS west
FROM customer) o GROUP BY map_url, href""",
    "v_links": f"""
SELECT DISTINCT 'https://g.example.com/n-' || {_s('l_orderkey')} AS src, 'https://g.example.com/n-' || {_s('l_partkey * 7 + l_suppkey')} || CASE WHEN l_linenumber = 6 THEN '.pdf' ELSE '' END AS dst, l_linenumber = 4 AS nofollow
FROM lineitem""",
    "v_coords": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE l_linenumber % 4 WHEN 0 THEN 'EPSG:3857' WHEN 1 THEN 'EPSG:32643' WHEN 2 THEN 'EPSG:32733' ELSE 'EPSG:7755' END AS crs,
       CASE WHEN l_linenumber % 4 = 0 THEN CAST(8000000 + l_partkey * 13 AS DOUBLE) ELSE CAST(300000 + l_partkey * 7 AS DOUBLE) END AS x,
       CASE WHEN l_linenumber % 4 = 2 THEN CAST(7000000 + l_suppkey * 101 AS DOUBLE) ELSE CAST(2500000 + l_suppkey * 97 AS DOUBLE) END AS y,
       {_s('72 + l_suppkey % 9')} || '.57140' || ',' || {_s('20 + l_linenumber')} || '.0225,0  999.9,555.5 bad 72.1,23.25' AS kml_text
FROM lineitem""",
    "v_geojson": f"""
SELECT s_suppkey AS doc_id, 'https://data.example.org/g' || {_s('s_suppkey')} || '.geojson' AS url,
       CASE WHEN s_suppkey % 10 = 9 THEN '{{broken' ELSE '{{"type":"FeatureCollection"' || CASE WHEN s_suppkey % 3 = 0 THEN ',"crs":{{"properties":{{"name":"urn:ogc:def:crs:EPSG::3857"}}}}' ELSE '' END
       || ',"features":[{{"type":"Feature","properties":{{"survey_no":"' || {_s('s_suppkey')} || '/1","area":1.5,"nested":{{"a":1}},"none":null}},"geometry":{{"type":"Point","coordinates":['
       || CASE WHEN s_suppkey % 3 = 0 THEN '8065000,2632000' WHEN s_suppkey % 7 = 0 THEN '999,555' ELSE '72.5,23.0' END || ']}}}},{{"type":"Feature","properties":{{}},"geometry":{{"type":"GeometryCollection","geometries":[]}}}}]}}' END AS body
FROM supplier""",
    # one KML document per customer: folders, an unclosed polygon, a two-part line, an
    # out-of-range point, a usable point and a ground overlay
    "v_kml": f"""
SELECT c_custkey AS doc_id, 'https://data.example.org/c' || {_s('c_custkey')} || '.kml' AS url, c_name AS name, c_mktsegment AS segment, n_name AS nation,
  CAST(70 + c_custkey % 20 AS BIGINT) AS lon, CAST(10 + c_custkey % 15 AS BIGINT) AS lat,
  '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>Land ' || n_name || '</name><Folder><name> ' || n_name || ' </name><Folder><name>' || c_mktsegment || '</name>'
  || '<Placemark><name>Survey ' || {_s('c_custkey')} || '/1</name><description>Plot &amp; yard</description><ExtendedData><Data name="village"><value>' || c_name || '</value></Data><SchemaData><SimpleData name="area_sqm">12.5</SimpleData></SchemaData></ExtendedData>'
  || '<Polygon><outerBoundaryIs><LinearRing><coordinates> ' || {_s('70 + c_custkey % 20')} || '.5,' || {_s('10 + c_custkey % 15')} || '.25,0 ' || {_s('70 + c_custkey % 20')} || '.6,' || {_s('10 + c_custkey % 15')} || '.25,0 ' || {_s('70 + c_custkey % 20')} || '.6,' || {_s('10 + c_custkey % 15')} || '.35,0 ' || {_s('70 + c_custkey % 20')} || '.5,' || {_s('10 + c_custkey % 15')} || '.35,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>'
  || '<Placemark><name>Lines</name><MultiGeometry><LineString><coordinates>1,2 3,4</coordinates></LineString><LineString><coordinates>5,6 7,8 9,10</coordinates></LineString></MultiGeometry></Placemark></Folder>'
  || '<Placemark><name>Bad</name><Point><coordinates>999.9,555.5</coordinates></Point></Placemark><Placemark><Point><coordinates>' || {_s('70 + c_custkey % 20')} || '.125,' || {_s('10 + c_custkey % 15')} || '.5</coordinates></Point></Placemark>'
  || '<GroundOverlay><name>Scan</name><Icon><href>https://img.example.org/scan-' || {_s('c_custkey')} || '.jpg</href></Icon><LatLonBox><north>' || {_s('11 + c_custkey % 15')} || '</north><south>' || {_s('10 + c_custkey % 15')} || '</south><east>' || {_s('71 + c_custkey % 20')} || '</east><west>' || {_s('70 + c_custkey % 20')} || '</west>' || CASE WHEN c_custkey % 2 = 0 THEN '<rotation>1.5</rotation>' ELSE '' END || '</LatLonBox></GroundOverlay></Document></kml>' AS body
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_gpx": f"""
SELECT c_custkey AS doc_id, 'https://data.example.org/t' || {_s('c_custkey')} || '.gpx' AS url, c_name AS name,
  CAST(10 + c_custkey % 15 AS BIGINT) AS lat,
  '<gpx><metadata><name>Walk ' || c_name || '</name></metadata><wpt lat="' || {_s('10 + c_custkey % 15')} || '.5" lon="72.25"><name>Corner</name></wpt><wpt lat="95" lon="0"/>'
  || '<trk><name>Edge</name><desc>Along the edge</desc><trkseg><trkpt lat="' || {_s('10 + c_custkey % 15')} || '.5" lon="72.5"/><trkpt lat="' || {_s('10 + c_custkey % 15')} || '.75" lon="72.75"/></trkseg></trk><rte><rtept lat="1" lon="2"/></rte></gpx>' AS body
FROM customer""",
    "v_rules": f"""
SELECT 'h' || {_s(_div('s_suppkey', 5))} || '.example.com' AS host, s_suppkey AS rule_ord, s_suppkey % 3 = 0 AS allow,
       CASE s_suppkey % 5 WHEN 0 THEN '/maps/' WHEN 1 THEN '/*.json$' WHEN 2 THEN '/maps/p-1' WHEN 3 THEN '/' ELSE '/m*/p-*5$' END AS pattern
FROM supplier""",
    "v_rule_urls": f"""
SELECT DISTINCT 'https://h' || {_s(_div('l_suppkey', 5))} || '.example.com/' || CASE WHEN l_linenumber = 1 THEN 'data/feed-' ELSE 'maps/p-' END || {_s(_REF_PAGE)} || CASE WHEN l_linenumber = 1 THEN '.json' WHEN l_linenumber = 2 THEN '?x=1' ELSE '' END AS url
FROM lineitem""",
    "v_robots": f"""
SELECT 'h' || {_s('s_suppkey')} || '.example.com' AS host,
       '# c' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /private/' || chr(10) || 'Crawl-delay: ' || {_s('s_suppkey % 4')} || ',5' || chr(10) || 'User-agent: BadBot' || chr(10)
       || 'Disallow: /' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'Disallow:' ELSE 'Allow: /private/ok.html # yes' END || chr(10)
       || CASE WHEN s_suppkey % 3 = 0 THEN 'User-agent: atlas' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /maps/*.kml$' || chr(10) ELSE '' END
       || 'Sitemap: https://h' || {_s('s_suppkey')} || '.example.com/sitemap.xml' AS text
FROM supplier""",
    "v_sitemaps": f"""
SELECT 'https://h' || {_s('s_suppkey')} || '.example.com/sitemap.xml' AS url,
       CASE WHEN s_suppkey % 4 = 0 THEN '<sitemapindex><sitemap><loc>https://h' || {_s('s_suppkey + 1')} || '.example.com/sitemap.xml</loc></sitemap></sitemapindex>'
       ELSE '<urlset><url><loc> https://h' || {_s('s_suppkey')} || '.example.com/a/?x=1&amp;z=2 </loc></url><url><loc>https://h.example.com/a/index.html?x=1</loc></url><url><loc>https://h.example.com/a/?x=1&amp;v=3</loc></url><url><loc>https://h.example.com/f.pdf</loc></url></urlset>' END AS text
FROM supplier""",
    "v_sitemap_tree": f"""
SELECT 'https://tree.example.com/' || {_s('s_suppkey')} || '.xml' AS url,
       CASE WHEN s_suppkey % 5 <> 0 THEN '<sitemapindex><loc>https://tree.example.com/' || {_s('2 * s_suppkey')} || '.xml</loc><loc>https://tree.example.com/' || {_s('2 * s_suppkey + 1')} || '.xml</loc><loc>https://tree.example.com/' || {_s(_div('s_suppkey', 3))} || '.xml</loc></sitemapindex>'
       ELSE '<urlset><loc>https://tree.example.com/d/' || {_s('s_suppkey % 9')} || '/index.html?utm_source=map</loc><loc>https://tree.example.com/p/' || {_s('s_suppkey')} || '/</loc></urlset>' END AS text
FROM supplier""",
    "v_crs": f"""
SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'urn:ogc:def:crs:OGC:1.3:CRS84' WHEN 2 THEN 'urn:ogc:def:crs:EPSG::32643' WHEN 3 THEN 'WGS84' WHEN 4 THEN 'EPSG:900913' WHEN 5 THEN '102100' WHEN 6 THEN NULL WHEN 7 THEN 'EPSG:7755' WHEN 8 THEN 'epsg 3785' ELSE 'EPSG:' || {_s('32600 + s_suppkey')} END AS raw
FROM supplier""",
    "v_urls": f"""
SELECT s_suppkey, CASE s_suppkey % 10 WHEN 0 THEN 'http://10.0.' || {_s('s_suppkey % 256')} || '.7/x' WHEN 1 THEN 'http://172.' || {_s('10 + s_suppkey % 40')} || '.0.1/' WHEN 2 THEN 'https://[::ffff:127.0.0.1]/' WHEN 3 THEN 'https://[2606:4700:4700::' || {_s('1000 + s_suppkey % 9000')} || ']/'
       WHEN 4 THEN 'ftp://example.com/' WHEN 5 THEN 'https://user:pw@example.com/' WHEN 6 THEN 'http://example.com:' || {_s('6370 + s_suppkey % 20')} || '/' WHEN 7 THEN 'printer.local/a' WHEN 8 THEN 'example.com' ELSE 'https://metadata.google.internal/' END AS input
FROM supplier""",
    "v_scans": f"""
SELECT o_custkey % 20 AS owner, o_orderkey AS scan_id, o_orderdate AS started_at, o_orderdate AS updated_at, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'stopped' ELSE 'completed' END AS status, o_totalprice AS bytes_fetched
FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. A table of fewer splits than cores is spread over all of them first:
    parsing is CPU-bound, and one small file would otherwise keep it in one task. On a
    cluster, where a table has many splits, nothing is moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LARGE and df.rdd.getNumPartitions() < cores else df


LARGE = {"lineitem", "orders", "part", "customer", "pages", "documents"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived view over ``sf_dir``; only the tables it names are opened."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    words = set(sql.replace("(", " ").split())
    for one in TABLES:
        if one in words:
            table(spark, sf_dir, one).createOrReplaceTempView(one)
    return spark.sql(sql)


def with_views(*names: str) -> str:
    """The opening ``WITH`` clause giving an SQL check the same views."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
