"""Permissions by prefix keys and sitemap frontiers against direct evaluation."""

import random

from pyspark.sql import functions as F

from atlasweave import constants as K
from atlasweave.operators.crawl import robots_allowed
from atlasweave.sources.robots import sitemap_seeds

RULES = "host string, rule_ord int, allow boolean, pattern string"


def _fits(path, pattern):
    """A pattern spelled out piece by piece: first piece at the start, the others behind it in order, the last at the end if anchored."""
    anchored = pattern.endswith("$")
    head, *others = pattern.removesuffix("$").split("*")
    if not path.startswith(head):
        return False
    at = len(head)
    for piece in others:
        at = path.find(piece, at) + len(piece) if piece in path[at:] else -1
        if at < 0:
            return False
    return not anchored or path.endswith((others or [head])[-1])


def _decide(path, rules):
    hits = [(len(p), allow, -n, p) for n, allow, p in rules if p and _fits(path, p)]
    return (max(hits)[1], max(hits)[3]) if hits else (True, None)


def test_permissions_equal_direct_evaluation(spark):
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rules = [(f"h{n % 4}.test", n, rng.random() < 0.5, rng.choice(["/", "/", "", "*"]) + word(5, "ab/*") + rng.choice(["", "", "$"])) for n in range(120)]
    urls = [f"https://h{rng.randint(0, 5)}.test/{word(7, 'ab/')}{rng.choice(['', '?a=b'])}" for _ in range(400)]
    got = robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, RULES)).collect()
    assert sorted(r.url for r in got) == sorted(urls)  # repeated rows stay
    for r in got:
        rest = r.url.removeprefix("https://")
        host, path = rest.split("/", 1)
        own = [(n, allow, p) for h, n, allow, p in rules if h == host]
        assert (r.allowed, r.rule) == _decide("/" + path, own), r.url


def test_permissions_of_one_large_site_and_odd_rows(spark):
    site = spark.range(20000).select(F.concat(F.lit("https://one.test/d"), (F.col("id") % 10).cast("string"), F.lit("/p"), F.col("id").cast("string")).alias("url"), F.lit("x").alias("_salt"), F.lit("y").alias("prefix"))
    many = spark.range(3000).select(F.lit("one.test").alias("host"), F.col("id").cast("int").alias("rule_ord"), F.lit(False).alias("allow"), F.concat(F.lit("/d3/p"), F.col("id").cast("string"), F.lit("$")).alias("pattern"))
    got = robots_allowed(site, many)
    # an anchored rule also needs its text at the end, so each forbids exactly one page
    assert got.filter("not allowed").count() == 300 and got.count() == 20000
    odd = spark.createDataFrame([(None,), ("mailto:a@b",), ("https://none.test/a",)], "url string")
    assert sorted((r.url or "", r.allowed, r.rule) for r in robots_allowed(odd, many).collect()) == [("", False, None), ("https://none.test/a", True, None), ("mailto:a@b", False, None)]
    assert robots_allowed(odd.filter("url like 'https%'"), many.limit(0)).first().allowed
    assert robots_allowed(odd.limit(0), many).count() == 0


def _map(*locs, index=False):
    return ("<sitemapindex>" if index else "<urlset>") + "".join(f"<loc>{u}</loc>" for u in locs)


def test_sitemaps_are_followed_to_the_end(spark):
    u = "https://s.test/"
    chain = [(f"{u}i{n}.xml", _map(f"{u}i{n + 1}.xml", f"{u}i0.xml", f"{u}m{n}.xml", index=True)) for n in range(7)]
    maps = chain + [(f"{u}m{n}.xml", _map(*(f"{u}p{n}-{k}" for k in range(60)), f"{u}p0-0", f"{u}f.pdf")) for n in range(7)] + [(None, None), (f"{u}none.xml", None)]
    table = spark.createDataFrame(maps, "url string, text string")
    starts = spark.createDataFrame([("s", f"{u}i0.xml", 0), ("s", f"{u}i0.xml", 4), ("s", f"{u}none.xml", 1), (None, f"{u}m1.xml", 0), ("t", f"{u}m6.xml", 0)], "site string, url string, pos int")
    got = sitemap_seeds(starts, table).collect()
    whole = [f"{u}p{n}-{k}" for n in range(7) for k in range(60)]
    assert [r.url for r in sorted((r for r in got if r.site == "s"), key=lambda r: r.seed)] == whole  # 420, beyond the old 300
    assert sorted(r.seed for r in got if r.site == "s") == list(range(1, 421))
    assert {r.url for r in got if r.site == "t"} == {f"{u}p6-{k}" for k in range(60)} | {f"{u}p0-0"}
    few = sitemap_seeds(starts, table, max_starts=K.MAX_SITEMAP_FOLLOWS + 1, max_follows=K.MAX_SITEMAP_FOLLOWS, max_seeds=100).collect()
    # three followed texts: i1 and m0 from i0, then the first new one of i1
    assert [r.url for r in sorted((r for r in few if r.site == "s"), key=lambda r: r.seed)] == [f"{u}p0-{k}" for k in range(60)]
    assert sitemap_seeds(starts.limit(0), table).count() == 0
