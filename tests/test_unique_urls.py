"""URLs that are known to be unique are read once for their permissions."""

from atlasweave.operators.crawl import robots_allowed


def test_unique_urls_are_read_once(spark):
    urls = spark.createDataFrame([("https://a.test/x/1",), ("https://a.test/y",), ("https://b.test/x",), ("no url",), (None,)], "url string")
    rules = spark.createDataFrame([("a.test", 1, False, "/x"), ("a.test", 2, True, "/x/*1$")], "host string, rule_ord int, allow boolean, pattern string")
    once, joined = robots_allowed(urls, rules, unique=True), robots_allowed(urls, rules)
    assert sorted(map(repr, once.select("url", "host", "allowed", "rule").collect())) == sorted(map(repr, joined.select("url", "host", "allowed", "rule").collect()))
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves(once) == leaves(joined) - 1
