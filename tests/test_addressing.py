import pytest
from pyspark.sql import functions as F

from tilewright.functions import addressing as A

# Known ids of tiles (z, x, y).
KNOWN = {(0, 0, 0): 0, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 0, 0): 5, (12, 3423, 1763): 19078479}


def test_known_ids(spark):
    df = spark.createDataFrame([(*k, v) for k, v in KNOWN.items()], "z int, x long, y long, want long")
    for r in df.select("*", A.hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("got")).collect():
        assert r["got"] == r["want"]


@pytest.mark.parametrize(("z", "x", "y"), [(32, 0, 0), (-1, 0, 0), (1, 2, 0), (1, 0, -1)])
def test_ids_outside_are_null(spark, z, x, y):
    df = spark.createDataFrame([(z, x, y)], "z int, x long, y long")
    assert df.select(A.hilbert_id(F.col("z"), F.col("x"), F.col("y"))).first()[0] is None


def test_round_trip(spark):
    rows = [(z, (7919 * z + 13 * k) % 2**z, (104729 * k + z) % 2**z) for z in range(32) for k in range(8)]
    df = spark.createDataFrame(rows, "z int, x long, y long")
    out = df.withColumn("id", A.hilbert_id(F.col("z"), F.col("x"), F.col("y"))).withColumn("zz", A.hilbert_zoom(F.col("id")))
    out = out.withColumn("t", A.hilbert_tile(F.col("id"), F.col("zz")))
    for r in out.collect():
        assert (r["zz"], r["t"]["x"], r["t"]["y"]) == (r["z"], r["x"], r["y"])


def test_base_is_exact_at_the_deepest_zoom(spark):
    assert spark.range(1).select(A.level_base(F.lit(31))).first()[0] == (4**31 - 1) // 3
