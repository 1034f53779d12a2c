"""A plain path behind a parsed base is joined to it and not parsed again, with the same result."""

from pyspark.sql import functions as F

from atlasweave.functions import urls as U

RAW = ["/a.png", "/", "//h.test/x", "/./a", "/.a", "/%2e/a", "a/b.png?q=1#f", "a:b", "/a:b", "mailto:x", "/a b", "a\\b", "./a", "a/..", "é", "/?q='", "x#f", "#f", "", "http:a", "[a]", "-a", "/a@b", None]
BASES = ["https://a.test/x/y", "https://u:p@A.test:443/x/", "http://a.test:8080//x/./y?z", "https://bücher.test/é/b", "https://[::1]/a", "no", None]


def test_plain_paths_are_joined_as_the_parser_would(spark, monkeypatch):
    df = spark.createDataFrame([(r, b) for r in RAW for b in BASES], "r string, b string")
    resolved = lambda: sorted(map(repr, U.with_resolved(df, "r", "b", "u").collect()))
    plain = resolved()
    monkeypatch.setattr(U, "_PLAIN_PATH", r"(?!)")
    assert resolved() == plain


def test_plain_paths_are_not_parsed(spark, monkeypatch):
    df = spark.createDataFrame([(r, "https://a.test/x/y") for r in ("/a.png", "b/c.png", "/d?e=1")], "r string, b string")
    df = U.with_url_parts(df, F.col("b"), "base")
    monkeypatch.setattr(U, "with_url_parts", lambda rows, url, p: U_parts(rows, F.when(F.col("_joined").isNotNull() & url.isNotNull(), F.raise_error(F.lit("parsed"))).otherwise(url), p))
    assert [r.u for r in U.with_resolved(df, "r", "b", "u", parsed="base").orderBy("u").collect()] == ["https://a.test/a.png", "https://a.test/d?e=1", "https://a.test/x/b/c.png"]


U_parts = U.with_url_parts
