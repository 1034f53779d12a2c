"""Full results where earlier versions cut them, and files that are not quite well formed."""

from pyspark.sql import functions as F

from atlasweave.functions.geometry import kml_positions
from atlasweave.functions.ordering import natural_key
from atlasweave.operators.assets import context_hint_sets
from atlasweave.operators.references import page_links, scan_references
from atlasweave.sources.geofiles import _tree, xml_features, xml_rows


def test_every_reference_and_link_of_a_page(spark):
    images = "".join(f'<img src="/i{n}.png">' for n in range(2105))
    links = "".join(f'<a href="/p{n}">x</a>' for n in range(612))
    styled = '<div style="' + "".join(f"background:url(/s{n}.png);" for n in range(15)) + '"></div>'
    pages = spark.createDataFrame([(1, "https://a.example/", f"<html><body>{images}{links}{styled}</body></html>")], "page_id long, url string, html string")
    found = scan_references(pages).groupBy("source_type").count().collect()
    counts = {r["source_type"]: r["count"] for r in found}
    assert counts.pop("img") == 2105 if "img" in counts else max(counts.values()) == 2105
    assert 15 in counts.values()
    assert page_links(pages).count() == 612
    assert page_links(pages, max_links=5).count() == 5


def test_positions_are_not_cut(spark):
    block = " ".join(f"{n % 170}.5,10" for n in range(100_050))
    row = spark.createDataFrame([(block,)], "c string").select(F.size(kml_positions(F.col("c"))["positions"]).alias("n")).first()
    assert row.n == 100_050


def test_long_digit_runs_order_by_value(spark):
    names = ["a" + "1" * 21, "a" + "1" * 20 + "2", "a" + "9" * 20, "a2", "a10", "a010"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["a2", "a010", "a10", "a" + "9" * 20, "a" + "1" * 21, "a" + "1" * 20 + "2"]


def test_tolerant_xml():
    tree = _tree('<?xml version="1.0" encoding="ISO-8859-1"?><k><n>A&nbsp;x Q & A é &#233; &amp;nbsp;</n><n><![CDATA[x & y]]></n><n>last')
    assert [n.text() for n in tree.children[0].children] == ["A\xa0x Q & A é é &nbsp;", "x & y", "last"]
    assert _tree('<?xml version="1.0" encoding="UTF-16"?><k><n>ü</n></k>').children[0].children[0].text() == "ü"


def test_long_descriptions_and_places_and_many_hints(spark):
    body = f"<kml><Document><Placemark><name>{'n' * 3000}</name><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>"
    files = spark.createDataFrame([("a", "https://x.test/a.kml", "kml", bytearray(body.encode()))], "asset_id string, url string, format string, body binary")
    assert [len(r.name) for r in xml_features(xml_rows(files)).collect()] == [3000]
    rows = [("s", "u", f"hint {n:02}", n, 0, 0, "o") for n in range(30)]
    refs = spark.createDataFrame(rows, "scan_id string, canonical_url string, context_hint string, page_seq int, path_rank int, ordinal int, original_url string")
    (row,) = context_hint_sets(refs).collect()
    assert row.context_hints == [f"hint {n:02}" for n in range(30)]
    assert context_hint_sets(refs, limit=8).first().context_hints == row.context_hints[:8]
