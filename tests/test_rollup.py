import random
from collections import Counter

from tilewright.operators import rollup


def test_sums_over_seams_equal_a_plain_count(spark):
    """A third of all rows are one tile, which spans tasks as all others do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(3)
    rows = [(7, 100, 27, 1)] * 500 + [(z, r.randrange(2**z), r.randrange(2**z), r.randrange(-3, 9)) for z in (r.choice([0, 1, 3, 6, 7, 9, 31]) for _ in range(1000))]
    want = Counter()
    for z, x, y, n in rows:
        for k in range(z + 1):
            want[k, x >> (z - k), y >> (z - k)] += n
    tiles = spark.createDataFrame(rows, "z int, x long, y long, n int").repartition(6)
    got = rollup.rollup(tiles)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = got.collect()
    assert {tuple(t)[:3]: t["total"] for t in found} == dict(want) and len(found) == len(want)
    assert rollup.rollup(tiles.limit(0)).count() == 0
    outside = spark.createDataFrame([(1, 5, 0, 1)], "z int, x long, y long, n int")
    assert rollup.rollup(outside).count() == 0
