"""Streams of references take the identity of a URL as derived once, and arrive as many files in few batches."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from atlasweave.operators import assets as A
from atlasweave.plans import stream_queries as S
from atlasweave.streaming import ingest as T
from atlasweave.views import view

SF = "/root/testdata/sf0.001"


def test_identified_references_are_not_parsed_again_in_the_stream(spark):
    refs = S._staged_refs(spark, SF, "scan_id", *A.ORDER, "source_page", "is_lazy", "resolved_url", "canonical_url")
    assert refs.isStreaming
    for step in (T.first_seen, T.first_pass):
        assert "Generate" not in step(refs)._jdf.queryExecution().analyzed().toString()


def test_every_reference_arrives_in_four_batches_at_most(spark):
    refs = S._staged_refs(spark, SF, "scan_id", "canonical_url")
    folder = T.work_folder(spark)
    T.write_changes(refs, folder).awaitTermination()
    log = T.changes(spark, folder)
    assert log.count() == A.identified_refs(view(spark, SF, "v_refs")).count()
    assert log.agg(F.max("batch_id")).first()[0] <= 3


def test_first_pass_gives_each_asset_once(spark):
    rows = [tuple(r) for r in entry.queries()["stream_first_pass"](spark, SF).collect()]
    known = A.identified_refs(view(spark, SF, "v_refs")).select("scan_id", "canonical_url").distinct().collect()
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in known}
