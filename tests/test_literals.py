"""Literal expectations for single functions."""

from pyspark.sql import functions as F

from atlasweave.functions import land, safety, urls as U
from atlasweave.operators.crawl import robots_allowed
from atlasweave.operators.references import parse_srcset
from atlasweave.sources.robots import robots_rules

BASE = "https://example.com/maps/town/"


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in make(df).orderBy("i").select("out").collect()]


def test_resolve(spark):
    cases = {
        "/images/p.jpg": "https://example.com/images/p.jpg", "./p.jpg": BASE + "p.jpg", "../a/p.png": "https://example.com/maps/a/p.png",
        "//cdn.example.com/a.webp": "https://cdn.example.com/a.webp", "https://CDN.example.com:443/a": "https://cdn.example.com/a",
        "?q=1": BASE + "?q=1", "../../../x/../y": "https://example.com/y", "/èê": "https://example.com/%C3%A8%C3%AA",
        "data:image/png;base64,iV": None, "javascript:void(0)": None, "#anchor": None, "": None,
    }
    got = column(spark, list(cases), lambda d: U.with_resolved(d.withColumn("b", F.lit(BASE)), "v", "b", "out"))
    assert got == list(cases.values())


def test_canonical(spark):
    cases = {
        "https://x.test/a.jpg?utm_source=n&b=2&a=1&fbclid=z&v=9": "https://x.test/a.jpg?a=1&b=2",
        "https://X.TEST:443/a.jpg#frag": "https://x.test/a.jpg", "https://x.test//a//b": "https://x.test/a/b",
        "https://x.test/?q=a%20b&q=2": "https://x.test/?q=a+b&q=2", "not a url": "not a url",
    }
    assert column(spark, list(cases), lambda d: U.with_canonical(d, "v", "out")) == list(cases.values())
    pages = {"https://x.test/a/index.html": "https://x.test/a", "https://x.test/a/": "https://x.test/a", "https://x.test/": "https://x.test/"}
    assert column(spark, list(pages), lambda d: U.with_canonical(d, "v", "out", page=True)) == list(pages.values())


def test_variants(spark):
    urls = [f"https://x.test/wp/{n}" for n in ("photo.jpg", "photo-300x200.jpg", "photo@2x.jpg", "photo.jpg?w=300", "photo-1024x768-300x200.jpg")]
    got = column(spark, urls, lambda d: U.with_variant_group(d, "v", "out"))
    assert got[0] is None and len(set(got[1:])) == 1


def test_srcset(spark):
    value = "  /a-320.jpg 320w ,\n /a-640.jpg 640w, https://cdn.example.com/x,y/a@2x.png 2x , /plain.jpg "
    df = spark.createDataFrame([(value,), (",,,",)], "v string").select(parse_srcset(F.col("v")).alias("c"))
    rows = [r.c for r in df.collect()]
    assert [c.url for c in rows[0]] == ["/a-320.jpg", "/a-640.jpg", "https://cdn.example.com/x,y/a@2x.png", "/plain.jpg"]
    assert (rows[0][0].width, rows[0][2].density, rows[0][3].descriptor) == (320, 2.0, None)
    assert rows[1] == []


def test_addresses(spark):
    blocked4 = ["127.0.0.1", "10.0.0.7", "172.31.255.254", "169.254.169.254", "0.0.0.0", "255.255.255.255", "240.0.0.1", "1.2.3"]
    open4 = ["8.8.8.8", "172.32.0.1", "192.169.0.1"]
    got = column(spark, blocked4 + open4, lambda d: d.withColumn("out", safety.ipv4_reason(F.col("v"))))
    assert all(got[: len(blocked4)]) and not any(got[len(blocked4):])
    blocked6 = ["::1", "::", "fc00::1", "fe80::1", "ff02::1", "::ffff:127.0.0.1", "64:ff9b::192.168.0.1", "2002::1"]
    open6 = ["2606:4700:4700::1111", "2a00:1450:4001:80e::200e", "::ffff:8.8.8.8"]
    got = column(spark, blocked6 + open6, lambda d: safety.with_ipv6_reason(d, "v", "out"))
    assert all(got[: len(blocked6)]) and not any(got[len(blocked6):])


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private/\nDisallow: /*.json$\nAllow: /private/public.html\n\nUser-agent: BadBot\nDisallow: /\n"
    rules = robots_rules(spark.createDataFrame([("x.test", text)], "host string, text string"), "atlasweave")
    cases = {"/": True, "/private/s.html": False, "/private/public.html": True, "/data/feed.json": False, "/data/feed.json?x=1": True}
    urls = spark.createDataFrame([(f"https://x.test{p}",) for p in cases], "url string")
    got = {r.url.removeprefix("https://x.test"): r.allowed for r in robots_allowed(urls, rules).collect()}
    assert got == cases


def test_survey_references(spark):
    cases = {"Survey No. 125/2": "125/2", "S.No 126/1/A": "126/1/A", "Final Plot 118": "118", "125/2": "125/2", "An ordinary title": None}
    none = F.array().cast("array<struct<key:string,value:string>>")
    assert column(spark, list(cases), lambda d: d.withColumn("out", land.survey_reference(F.col("v"), none))) == list(cases.values())
