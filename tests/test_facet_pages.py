"""Pages by their number of assets."""

from atlasweave.operators import explore as X


def test_only_listed_pages_get_a_label(spark):
    refs = spark.createDataFrame([("https://a.test/p-1", "i1"), ("https://a.test/p-2", "i1"), ("https://a.test/p-2", "i2")], "source_page string, asset_id string")
    top = X.facet_pages(refs, limit=1)
    assert [tuple(r) for r in top.collect()] == [("https://a.test/p-2", 2, "a.test → p 2")]
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("GlobalLimit") > plan.index("Generate inline")
