"""White space and ports of URLs: equal to the SQL, without an error raised and caught for each row."""

import duckdb
from pyspark.sql import functions as F

from atlasweave.functions.text import SPACE, SPACES, squish, strip
from atlasweave.functions.urls import with_url_parts
from atlasweave.plans import duck as D

EDGES = [c + t + c for t in ("a", "a b", "é　 x", "") for c in (*SPACES, " \n", "\x85", " \x85", "​", "᠎", "\x1c", "!")]


def test_white_space_equals_sql(spark):
    texts = [*EDGES, "a \x85", "a \r\n\x85", "x   y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", strip(F.col("t")).alias("a"), squish(F.col("t")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == duckdb.execute(f"SELECT {D.strip('x')}, {D.squish('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone(), repr(t)
    every = spark.range(0x10000).filter("id not between 55296 and 57343 and id <> 65279").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"))
    assert every.filter(F.col("c").rlike(SPACE) != (strip(F.col("c")) == "")).count() == 0


def test_ports(spark):
    known = {"": "", ":": "", ":443": "", ":0443": "", ":8080": "8080", ":65535": "65535", ":65536": None, ":99999": None, ":0": "0", ":00000": "0", ":0000000080": "80", ":100000": None, ":99999999999": None}
    df = spark.createDataFrame([(p, f"https://a.test{p}/x") for p in known], "p string, url string")
    parts = with_url_parts(df, F.col("url"), "u")
    assert {r.p: r.u_port for r in parts.collect()} == known
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast(" not in plan  # a failed cast of an empty port raises an error inside, for every row
