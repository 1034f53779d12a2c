"""Place properties of a feature are read once."""

from pyspark.sql import functions as F

from atlasweave import constants as K
from atlasweave.functions import land


def test_place_properties_are_read_once(spark):
    entries = [[("Village", "A b"), ("taluka", "a B"), ("district", " D "), ("state", "")], [("x", "y")], None]
    df = spark.createDataFrame([(e,) for e in entries], "entries array<struct<key:string,value:string>>")
    steps = land.place_steps(F.col("entries"))
    assert [[tuple(s) for s in r[0]] if r[0] is not None else None for r in df.select(steps).collect()] == [[("D", "district"), ("A b", "village")], [], None]
    # keys are normalised once for each kind of place
    text = df.select(steps.alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count(r"\s+") == len(K.PLACE_KEYS)
