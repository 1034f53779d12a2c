"""URLs are identified once for each distinct one, and images are looked at only on pages with parcels."""

from pyspark.sql import functions as F

from atlasweave.functions import urls as U
from atlasweave.operators import assets as A, links as LK

RAW = ["https://A.test:443//b?b=2&a=1&utm_source=n", "HTTPS://a.test/c", "../d.png", "//h.test/e", "", "#f", "mailto:x", "https:q", None]
PAGES = ["https://a.test/x/y", "https://b.test/x/y", "not a page", None]


def test_identity_is_derived_for_distinct_urls_only(spark):
    rows = [(u, p, i) for i in range(3) for u in RAW for p in PAGES]
    refs = spark.createDataFrame(rows, "original_url string, source_page string, n int")
    direct = U.with_canonical(A.with_resolved_refs(refs), "resolved_url", "canonical_url").select(*refs.columns, "resolved_url", "canonical_url")
    found = A.identified_refs(refs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, direct.collect()), key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed = min(i for i in range(len(plan)) if "Generate inline" in plan[i])
    assert any("Aggregate [original_url" in line for line in plan[parsed:])  # distinct URLs below the parser


def test_images_of_pages_without_parcels_are_not_read_on(spark):
    images = spark.createDataFrame([("i1", 1, "https://a.test/a.png", "p1"), ("i2", 2, "https://a.test/b.png", "p2")], "asset_id string, seq int, url string, source_page string")
    images = images.withColumns({"width": F.lit(1), "height": F.lit(1), "filename": F.lit("a.png"), "alt_text": F.lit(None).cast("string"), "title": F.lit(None).cast("string")})
    shown = spark.createDataFrame([("p1", "i1"), ("p2", "i2"), ("p2", "i1")], "source_page string, asset_id string")
    pages = spark.createDataFrame([("p1",)], "source_page string")
    assert [(r.source_page, r.asset_id) for r in LK.candidate_images(images, shown, pages).collect()] == [("p1", "i1")]
