"""References of some types are scanned without reading the other tags of a page."""

from atlasweave.operators import references as R
from atlasweave.views import view

PAGE = """<html><head><LINK REL=icon HREF=/i.ico><link/rel="image_src" href="/s.png"><meta name="twitter:image" content="/t.png"><style>a{background:url(/c.png)}</style></head>
<body style="background:url('/b.png')"><linked href="/no.ico"><a href="/x.kml" title="url(">k</a><p data-src="/lazy.png" data-kml="/y.kml">t</p><picture><source srcset="/q.webp 2x"><img
src="/p.png" srcset="/p2.png 2x"></picture><video poster=/v.jpg></video><object type="image/png" data="/o.png"></object><iframe src="https://v.test/?u=https%3A%2F%2Fd.test%2Fl.kmz"></iframe></body></html>"""


def test_types_alone_give_what_the_whole_scan_gives(spark):
    odd = spark.createDataFrame([(1, "https://a.test/x/", PAGE), (2, "https://b.test/", ""), (3, "https://b.test/", None)], "page_id long, url string, html string")
    given = view(spark, "/root/testdata/sf0.001", "v_html").limit(5).select("page_id", "url", "html").collect()
    pages = odd.unionByName(spark.createDataFrame(given, odd.schema))
    every = R.scan_references(pages).collect()
    some = ["link-icon", "lazy-attribute", "css-inline", "meta-other"]
    assert {r.source_type for r in every} > set(some)
    found = R.scan_references(pages, some).collect()
    assert sorted(map(repr, found)) == sorted(repr(r) for r in every if r.source_type in some)
    found = R.scan_references(pages, ["link-icon"]).collect()
    assert sorted(map(repr, found)) == sorted(repr(r) for r in every if r.source_type == "link-icon")


def test_other_tags_are_left_out_before_their_attributes_are_read(spark):
    pages = spark.createDataFrame([(1, "https://a.test/x/", PAGE)], "page_id long, url string, html string")
    tags = [r.tag for r in R.tag_elements(pages, R.tags_of(["link-icon"])).collect()]
    assert tags == ["link", "link"]
