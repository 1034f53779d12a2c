"""The land-record model merges references by URL and derives only the columns a query asks for."""

from pyspark.sql import functions as F

from atlasweave.operators import assets as A, parcels as P
from atlasweave.plans.geo_queries import features
from atlasweave.plans.place_queries import Model
from atlasweave.views import view

SF = "/root/testdata/sf0.001"


def test_assets_merged_by_url_are_the_consolidated_ones(spark):
    raw = ["https://A.test:443//b?b=2&a=1&utm_source=n", "https://a.test/b?a=1&b=2", "../d.png", " https://a.test/d.png", "https:q", "#f", None]
    rows = [("s%d" % (i % 2), i % 5, i % 3, i % 4, u, p, None if i % 2 else f"alt {i}", None if i % 3 else f"t {i}")
            for i, (u, p) in enumerate([(u, p) for u in raw for p in ("https://a.test/x/y", "https://b.test/x/y", "no page", None)] * 3)]
    refs = spark.createDataFrame(rows, "scan_id string, page_seq long, path_rank long, ordinal long, original_url string, source_page string, alt_text string, title string")
    refs = refs.withColumns({"source_type": F.lit("img"), "descriptor": F.lit(None).cast("string"), "element_path": F.lit("img"), "is_lazy": F.lit(False)})
    for df in (refs, view(spark, SF, "v_refs")):
        urls = A.merged_refs(df)
        found = A.assets_of_urls(urls)
        known = A.consolidate_assets(A.identified_refs(df))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, known.select(found.columns).collect()))
        shown = A.page_assets(df, urls)
        assert shown.count() == shown.distinct().count() == A.identified_refs(df).select("scan_id", "canonical_url", "source_page").distinct().count()


def test_columns_that_are_not_asked_for_are_not_derived(spark):
    given = features(spark, SF).withColumn("scan_id", F.lit("all"))
    some = P.parcels(given, ["parcel_id", "kml_available"])
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "extent" not in plan and "loc_" not in plan
    every = P.parcels(given)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(some.columns).collect()))
    for columns in (Model.LINKED, [*Model.LINKED, "ord", "nodes", "location_id", "ancestor_ids", *P.BBOX], ["area_basis", "geometry_availability", "geometry_source"]):
        assert sorted(map(repr, P.parcels(given, columns).collect())) == sorted(map(repr, every.select(columns).collect()))
