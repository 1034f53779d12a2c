"""Tables read once where several branches need them, and streams over tables of one or many files."""

import shutil
import tempfile

import __spark_entry__ as entry
from atlasweave.operators.references import page_links
from atlasweave.streaming import ingest as T
from atlasweave.views import view

SF = "/root/testdata/sf0.001"


def test_references_of_a_page_are_scanned_once(spark):
    plan = entry.queries()["all_references"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == 2  # all kinds of references, and link texts


def test_references_are_resolved_once(spark):
    for name in ("asset_by_id", "images_by_page"):
        assert entry.queries()[name](spark, SF).inputFiles() == [], name


def test_stream_over_a_table_of_many_files(spark):
    pages = view(spark, SF, "pages")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    pages.repartition(2).write.parquet(f"{folder}/pages.parquet")
    want = sorted((r.page_id, r.link) for r in page_links(pages).collect())
    for source in (folder, SF):
        got = entry.queries()["stream_page_links"](spark, source)
        assert sorted((r.page_id, r.link) for r in got.collect()) == want


def test_a_batch_of_one_file_is_spread(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    shutil.copy(f"{SF}/part.parquet", folder)
    sizes = []

    def note(batch):
        sizes.append(batch.rdd.getNumPartitions())
        return batch

    stream = T.page_stream(spark, folder, view(spark, SF, "part").schema)
    T.write_changes(stream, T.work_folder(spark), note).awaitTermination()
    assert sizes == [spark.sparkContext.defaultParallelism]
