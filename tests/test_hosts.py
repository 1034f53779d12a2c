"""Unicode host names against the standard library's encoder and known forms."""

import random

from pyspark.sql import functions as F

from atlasweave.functions.hosts import ascii_host, punycode
from atlasweave.functions.urls import with_canonical, with_resolved


def test_labels_equal_the_standard_encoder(spark):
    rng = random.Random(8)
    letters = "ab-0z" + "éüßñžжщ日本語ไทย한ا" + "\U0001f600\U00010400\U0010ffff"
    labels = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(800)]
    labels += ["é" * 300, "\U0010ffff" * 60 + "a", "a" + "\U0010ffff", "-é", "é-", "é"]
    df = spark.createDataFrame([(x,) for x in labels], "label string").filter(F.col("label").rlike("[^\\x00-\\x7f]"))
    wrong = [r.label for r in df.withColumn("form", punycode("label")).collect() if r.form != r.label.encode("punycode").decode()]
    assert wrong == []


def test_host_forms(spark):
    known = {
        "bücher.example": "xn--bcher-kva.example", "faß.de": "xn--fa-hia.de", "日本。jp": "xn--wgv71a.jp", "éa.test": "xn--a-9fa.test",
        "ｅｘａｍｐｌｅ．com": "example.com", "ﬁn.test": "fin.test", "x­y.test": "xy.test", "a.b": "a.b", "": "", "xn--bcher-kva.de": "xn--bcher-kva.de",
    }
    df = spark.createDataFrame([(k,) for k in known] + [(None,)], "host string").withColumn("form", ascii_host("host"))
    assert {r.host: r.form for r in df.collect()} == known | {None: None}


def test_urls_of_one_host_in_any_spelling_are_one(spark):
    urls = ["https://BÜCHER.example/a", "https://bücher.example:443/a", "https://xn--bcher-kva.example/a", "https://bücher。example/a"]
    df = with_canonical(spark.createDataFrame([(u,) for u in urls], "url string"), "url")
    assert {r.canonical_url for r in df.collect()} == {"https://xn--bcher-kva.example/a"}
    refs = spark.createDataFrame([("//ΣΑΣ.gr/x", "https://é.test/d/"), ("y", "https://é.test/d/"), ("//a／b.test/", "https://é.test/d/")], "raw string, base string")
    assert [r.resolved for r in with_resolved(refs, "raw", "base").collect()] == ["https://" + "xn--" + "σασ".encode("punycode").decode() + ".gr/x", "https://xn--9ca.test/d/y", None]
