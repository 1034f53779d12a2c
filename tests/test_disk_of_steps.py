"""What a query shuffles and writes on its way: no more than its result takes, and not kept longer than it is used."""

import time

from pyspark.sql import functions as F

from atlasweave.functions.prefilter import likely
from atlasweave.operators import assets as A, links as LK, parcels as P
from atlasweave.plans.place_queries import Model
from atlasweave.session import written

SF = "/root/testdata/sf0.001"


def test_shuffles_go_when_their_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    on_disk = lambda: {b.toString() for b in (disk.getAllBlocks().apply(i) for i in range(disk.getAllBlocks().size())) if "shuffle" in b.toString()}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = spark.conf.get(setting, None), on_disk()
    df = spark.range(100_000).groupBy((F.col("id") % 70).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = written(df)
    for _ in range(40):
        if on_disk() <= before:
            break
        time.sleep(0.25)
    assert on_disk() <= before
    assert spark.conf.get(setting, None) in (held, "false")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))


def test_no_row_of_a_join_is_dropped_before_it(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("b"))
    some = rows.filter("a % 50 = 1").distinct()
    kept = likely(rows, some, ["a", "b"])
    assert kept.columns == rows.columns and kept.count() < 600
    want = rows.join(some, ["a", "b"]).collect()
    assert want and sorted(kept.join(some, ["a", "b"]).collect()) == sorted(want)
    assert likely(rows, some.limit(0), ["a", "b"]).count() == 0


def test_only_images_on_pages_with_parcels_are_kept_for_links(spark):
    model = Model(spark, SF, Model.LINKED)
    every = A.page_assets(model.references, model.urls)
    pages = model.records.select("source_page").distinct()
    assert model.page_images.count() < every.count() / 2
    near = every.join(pages, "source_page", "left_semi")
    assert sorted(map(tuple, model.page_images.collect())) == sorted(map(tuple, near.collect()))
    # sizes come from all pages that show an image, not from those alone
    counts = {r.asset_id: r.n for r in every.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {r.asset_id: r.page_count for r in model.images.collect()}
    assert sizes and all(counts[a] == n for a, n in sizes.items())


def test_counted_imagery_is_that_of_its_records(spark):
    model = Model(spark, SF)
    counted = {tuple(r) for r in model.imagery_pages.select("map_id", "location_id", "images").collect()}
    records = model.imagery.groupBy("map_id", "location_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert counted and counted == {tuple(r) for r in records}
    pages = model.imagery_pages.limit(2)
    assert model.imagery_on(pages).select("source_page").distinct().count() == 2


def test_only_unnamed_features_are_numbered_whole(spark, monkeypatch):
    seen = []
    number = P.number_rows
    monkeypatch.setattr(P, "number_rows", lambda df, *rest: seen.append(df) or number(df, *rest))
    Model(spark, SF).records.count()
    assert seen[0].columns == ["scan_id", "ord", "_row"]
    assert 0 < seen[0].filter("_row is not null").count() < seen[0].count()


def test_images_of_links_are_ordered_by_number(spark):
    rows = [("a", ("z", 2), 5, 5), ("b", ("y", 1), 5, 5), ("c", ("x", 0), 1, 1), ("d", ("w", 0), None, 9)]
    images = spark.createDataFrame(rows, "asset_id string, seq struct<u:string,n:int>, width int, height int")
    assert {r.asset_id: r.seq for r in LK.ordered_images(images).collect()} == {"b": 1, "a": 2, "c": 3, "d": 4}
