"""URLs parsed in one step: plain ones are cut at their delimiters, and give what the whole grammar gives."""

import pytest
from pyspark.sql import functions as F

from atlasweave.functions import urls as U
from atlasweave.operators import parcels as P
from atlasweave.plans.geo_queries import features

URLS = [
    "https://A.test:443/b//c?x=1#f", "HTTP://a.test", "http://a.test?", "http://a.test:80?q/z?y", "https://a.test:8080/x.y/z;p=1", "http://a.test/#?/x",
    "https://a.test/./x/../y", "https://a.test/a%2e/%2Eb", "https://u:p@a.test/", "https://a.test:0443/", "https://a.test:/x", " http://a.test/ ", "http://a.test/a\\b",
    "http://a.test/é?'", "https://m\u00fcnchen.test/", "http://a.test/x\n", "http://a.test/x\u2028", "http://a.test?x\ty", "ftp://a.test/", "http:///x", "", None,
]


def test_plain_urls_equal_the_whole_grammar(spark, monkeypatch):
    rows = [(u, r) for u in URLS for r in ("", "../y?z", "//h.test/p", "https:q", "HTTP:/\\h/p", "http://b.test/c", "#f")]
    df = spark.createDataFrame(rows, "u string, r string")
    derived = lambda: sorted(map(tuple, U.with_canonical(U.with_resolved(U.with_url_parts(df, F.col("u"), "p"), "r", "u"), "u").collect()), key=repr)
    plain = derived()
    assert sum(r[2] is not None for r in plain) > 100
    monkeypatch.setattr(U, "_PLAIN", r"(?!)")
    assert derived() == plain


@pytest.mark.parametrize("step, most", [(lambda df: U.with_url_parts(df, F.col("u"), "p"), 2), (lambda df: U.with_resolved(df, "r", "u"), 5)])
def test_a_url_takes_few_steps(spark, step, most):
    plan = step(spark.createDataFrame([("http://a.test/", "x")], "u string, r string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") <= most


def test_features_are_derived_once_for_their_numbers(spark, monkeypatch):
    seen = []
    number = P.number_rows
    monkeypatch.setattr(P, "number_rows", lambda df, *rest: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or number(df, *rest))
    P.parcels(features(spark, "/root/testdata/sf0.001").withColumn("scan_id", F.lit("all")))
    assert "Generate" not in seen[0]


def test_the_grammar_is_built_once(spark, monkeypatch):
    df = spark.createDataFrame([("http://a.test/", "x")], "u string, r string")
    U.with_url_parts(df, F.col("u"), "p")
    built = []
    make = U._any_parts
    monkeypatch.setattr(U, "_any_parts", lambda url: built.append(1) or make(url))
    U.with_url_parts(U.with_resolved(df, "r", "u"), F.col("u"), "p")
    assert built == []
