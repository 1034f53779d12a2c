"""Registered queries against their SQL checks at the smallest scale, and skew."""

import importlib.util
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atlasweave.operators.assets import consolidate_assets, mark_content_duplicates
from atlasweave.views import TABLES

SF = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)
CHOSEN = ["consolidate_links", "consolidate_assets", "verify_assets", "content_duplicates", "kml_features", "geojson_features", "locations", "robots_allowed", "image_headers",
          "unique_entry_names", "archive_budget", "download_manifest", "context_hint_sets"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows(df.columns, df.collect()) == check.rows(cols, cur.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hot_asset_counts_are_exact(spark):
    """A logo on every page: a third of all references share one asset."""
    n = 3000
    refs = spark.range(n).select(
        F.lit("s").alias("scan_id"), F.concat(F.lit("https://x.test/p"), F.col("id").cast("string")).alias("source_page"), F.lit("img").alias("source_type"),
        F.when(F.col("id") % 3 == 0, "https://x.test/logo.png").otherwise(F.concat(F.lit("https://x.test/i"), F.col("id").cast("string"))).alias("resolved_url"),
        F.lit(None).cast("string").alias("descriptor"), F.lit("img").alias("element_path"), F.lit(None).cast("string").alias("alt_text"),
        F.lit(None).cast("string").alias("title"), F.lit(False).alias("is_lazy"), F.col("id").alias("page_seq"), F.lit(0).alias("path_rank"), F.lit(0).alias("ordinal"),
    ).withColumn("original_url", F.col("resolved_url"))
    logo = consolidate_assets(refs).filter("url = 'https://x.test/logo.png'").collect()
    assert [(r.page_count, r.reference_count, r.source_page) for r in logo] == [(n // 3, n // 3, "https://x.test/p0")]


def test_duplicates_keep_the_earliest(spark):
    rows = [("s", 2, "b", "h", "available"), ("s", 1, "a", "h", "available"), ("s", 3, "c", "h", "redirected"), ("s", 4, "d", None, "available")]
    df = spark.createDataFrame(rows, "scan_id string, seq int, asset_id string, content_hash string, status string")
    got = {r.asset_id: (r.is_duplicate, r.duplicate_of, r.status) for r in mark_content_duplicates(df).collect()}
    assert got == {"a": (False, None, "available"), "b": (True, "a", "duplicate"), "c": (True, "a", "redirected"), "d": (False, None, "available")}
