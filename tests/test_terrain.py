import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blocks, dem, directories, landcover, pyramid
from tilewright.operators import requests as R
from tilewright.sources import tile_table

SAMPLES = "lat double, lon double, step double, metres double"


def grid(step, south, west, rows, cols, height):
    return [(south + i * step, west + j * step, step, float(height)) for i in range(rows) for j in range(cols)]


@pytest.fixture(scope="module")
def seam():
    """A fine cell beside a coarse one, in one tile, and a coarse sample that stands twice."""
    return grid(0.25, 10, 10, 9, 9, 100) + grid(0.5, 10, 12, 9, 9, 40) + [(10.0, 12.0, 0.5, 30.0)]


def test_resampling_does_not_depend_on_the_order(spark, seam):
    got = []
    for seed in range(3):
        rows = list(seam)
        random.Random(seed).shuffle(rows)
        got.append(sorted(map(tuple, dem.resample(spark.createDataFrame(rows, SAMPLES).coalesce(1), 5, 32).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 0
    heights = {m for *_, m in got[0]}
    assert heights <= {0, 40, 100} and {40, 100} <= heights
    # where both grids reach, the finer one counts
    both = dem.resample(spark.createDataFrame(grid(0.25, 10, 10, 9, 9, 100) + grid(0.5, 10.5, 10.5, 3, 3, 40), SAMPLES), 5, 32)
    assert {r["metres"] for r in both.collect()} == {0, 100}


def by_samples(rows, zoom, size, margin=2):
    """Pixels of all tiles that samples touch, sample by sample: the plain form of the block operators."""
    n, grids, tiles = 2**zoom, {}, set()
    row_of = lambda lat: (1 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / math.pi) / 2 * n
    for lat, lon, step, metres in rows:
        cols = range(math.floor((lon - margin * step + 180) / 360 * n), math.floor((lon + margin * step + 180) / 360 * n) + 1)
        tiles |= {(x, y) for x in cols for y in range(math.floor(row_of(lat + margin * step)), math.floor(row_of(lat - margin * step)) + 1)}
        if metres != dem.NODATA:
            at = (round(lat / step), round(lon / step))
            grids.setdefault(step, {})[at] = max(metres, grids.get(step, {}).get(at, -1e9))
    out = {}
    for x, y in tiles:
        tile = {}
        for gy in range(y * size, y * size + size):
            lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (gy + 0.5) / (n * size)))))
            for gx in range(x * size, x * size + size):
                lon, value = (gx + 0.5) / (n * size) * 360 - 180, 0.0
                for step in sorted(grids, reverse=True):
                    v, u = lat / step, lon / step
                    near = [((1 - abs(v - a)) * (1 - abs(u - b)), grids[step][a, b]) for a in (math.floor(v), math.floor(v) + 1) for b in (math.floor(u), math.floor(u) + 1) if (a, b) in grids[step]]
                    if sum(w for w, _ in near) > 0:
                        value = sum(w * g for w, g in near) / sum(w for w, _ in near)
                tile[zoom, gx, gy] = value
        if max(tile.values()) > 0.5:
            out |= {at: round(value) for at, value in tile.items()}
    return out


def test_blocks_of_samples_equal_the_plain_form(spark):
    r = random.Random(3)
    rows = [(lat, lon, step, float(r.randrange(-20, 900))) for lat, lon, step, _ in grid(0.125, 44, 6, 17, 25, 0) + grid(0.25, 45.5, 5.25, 9, 9, 0) if r.random() < 0.9]
    rows += [(*at[:3], dem.NODATA) for at in rows[::40]] + [(-3.125, -0.125, 0.125, 40.0), (-3.0, 0.0, 0.125, 60.0)]
    for zoom, size in ((9, 8), (5, 16)):
        got = dem.resample(spark.createDataFrame(rows, SAMPLES), zoom, size).collect()
        assert {(p["z"], p["gx"], p["gy"]): p["metres"] for p in got} == by_samples(rows, zoom, size)


def test_only_edges_go_to_neighbours(spark):
    samples = spark.createDataFrame(grid(1 / 32, 10, 10, 64, 64, 50), SAMPLES)
    parts = dem.halo(dem.sample_blocks(samples), 12).collect()
    own = {(p["lat"], p["lon"]): p["rows"] * p["cols"] for p in parts if (p["row0"] // 32, p["col0"] // 32) == (p["lat"], p["lon"])}
    strips = [p for p in parts if (p["row0"] // 32, p["col0"] // 32) != (p["lat"], p["lon"])]
    assert {(10, 10), (10, 11), (11, 10), (11, 11)} <= set(own) and all(n == 32 * 32 for k, n in own.items() if k in {(10, 10), (11, 11)})
    assert strips and all(min(p["rows"], p["cols"]) <= 5 for p in strips)


def test_a_bake_goes_on_where_the_ledger_ends(spark, seam, tmp_path):
    samples = dem.sample_blocks(spark.createDataFrame(seam, SAMPLES))
    cells = spark.createDataFrame([(10, 10), (11, 13), (10, 12)], "lat int, lon int")
    none, done = spark.createDataFrame([], blocks.BLOCKS), spark.createDataFrame([], "unit string")
    whole, ledger = dem.bake(cells, samples, none, done, 9, 16)
    first, part = dem.bake(cells.where("lat = 10 and lon = 10"), samples, none, done, 9, 16)
    second, rest = dem.bake(cells, samples, first, part, 9, 16)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, whole.collect())) and whole.count() > first.count() > 0
    assert sorted(r["unit"] for r in rest.collect()) == sorted(r["unit"] for r in ledger.collect()) == ["z9:10,10", "z9:10,12", "z9:11,13"]
    again, _ = dem.bake(cells, samples.limit(0), second, rest, 9, 16)
    assert again.count() == whole.count()
    dem.publish(whole, str(tmp_path / "terrain"), 16)
    tiles, about = tile_table.read(spark, str(tmp_path / "terrain"))
    assert about["max_zoom"] == 9 and {r["z"] for r in tiles.select("z").distinct().collect()} == set(range(1, 10))
    back = blocks.of_terrarium(tiles.where("z = 9"))
    assert sorted(map(tuple, back.select("z", "x", "y", "block").collect())) == sorted(map(tuple, whole.select("z", "x", "y", "block").collect()))


def test_levels_of_blocks_equal_the_plain_form(spark):
    r = random.Random(7)
    tiles = {(x, y): np.array([[r.randrange(-400, 300) if (x + y) % 3 else -r.randrange(3) for _ in range(4)] for _ in range(4)]) for x in range(11) for y in range(7) if r.random() < 0.8}
    pixels = [(6, x * 4 + i, y * 4 + j, int(t[j, i])) for (x, y), t in tiles.items() for i in range(4) for j in range(4)]
    want, now, z = {}, {k: t for k, t in tiles.items() if (t > 0).any()}, 6
    while z >= 0:
        want |= {(z, *k): t.astype("<i2").tobytes() for k, t in now.items()}
        up = {}
        for (x, y), t in now.items():
            up.setdefault((x // 2, y // 2), np.zeros((8, 8)))[y % 2 * 4 : y % 2 * 4 + 4, x % 2 * 4 : x % 2 * 4 + 4] = t
        now, z = {k: m for k, c in up.items() if ((m := np.rint(c.reshape(4, 2, 4, 2).mean(axis=(1, 3)))) > 0).any()}, z - 1
    table = blocks.of_pixels(spark.createDataFrame(pixels, blocks.PIXELS), 4)
    assert {(b["z"], b["x"], b["y"]): bytes(b["block"]) for b in pyramid.pyramid(table, 4).collect()} == want
    assert pyramid.pyramid(table.limit(0), 4).count() == 0
    flat = spark.createDataFrame([(5, x, y, 700) for x in range(64) for y in range(64)], blocks.PIXELS)
    assert {(b["lowest"], b["highest"]) for b in blocks.to_pixels(pyramid.pyramid(blocks.of_pixels(flat, 2), 2).where("z > 0"), 2).groupBy("z").agg(F.min("metres").alias("lowest"), F.max("metres").alias("highest")).collect()} == {(700, 700)}
    plan = pyramid.level_up(table, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # pixels to tiles, tiles to ancestors


def test_one_busy_client_is_folded_as_a_stream(spark):
    rows = spark.range(30_000).selectExpr("7L as client", "id * 3 as ms", "id as event_id", "1 + id % 3 as cost")
    got = [r["allowed"] for r in R.token_bucket(rows, 125, 16 * R.UNIT).orderBy("event_id").collect()]
    tokens, last, want = 16 * R.UNIT, 0, []
    for i in range(30_000):
        tokens, last = min(16 * R.UNIT, tokens + (i * 3 - last) * 125), i * 3
        ok = tokens >= (1 + i % 3) * R.UNIT
        tokens -= (1 + i % 3) * R.UNIT * ok
        want.append(ok)
    assert got == want


def test_refused_requests_and_empty_tiles(spark):
    log = [(i, 1, 1_000 + i, "coarse", "5", "1", "1", False) for i in range(4)] + [(4, 1, 1_004, "coarse", "11", "9", "9", False), (5, 2, 1_000, "bundle2", "11", "1", "1", False), (6, 2, 1_001, "bundle2", "11", "1", "1", False), (7, 3, 1_000, "coarse", "5", "2", "2", False)]
    requests = spark.createDataFrame(log, "event_id long, client long, ms long, kind string, z string, x string, y string, extra boolean")
    tiles = spark.createDataFrame([(5, 1, 1, b"x")], "z int, x long, y long, payload binary")
    out = {r["event_id"]: (r["outcome"], r["status"]) for r in R.answer(requests, tiles, 0, 4 * R.UNIT - 1 + 1).collect()}
    assert [out[i] for i in range(4)] == [("ok", 200)] * 4 and out[4] == ("blocked", 404)
    assert out[5] == ("ok", 200) and out[6] == ("cached", 200) and out[7] == ("empty", 204)
    tight = {r["event_id"]: (r["outcome"], r["status"]) for r in R.answer(requests, tiles, 0, 3 * R.UNIT).collect()}
    assert tight[3] == ("limited", 429) and tight[6] == ("limited", 429)


def test_leaves_stay_in_their_interval(spark):
    rows = [(1, 0, 0, 5, 0, 0, 9), (1, 10, 0, 5, 5, 10, 20), (1, 20, 0, 5, 10, 19, 25), (1, 30, 2, 5, 15, None, None)]
    got = {r["tile_id"]: r["bounded"] for r in directories.audit(spark.createDataFrame(rows, "archive int, tile_id long, run long, length long, offset long, low long, high long"), 100).collect()}
    assert got == {0: True, 10: False, 20: False, 30: True}


def test_woods_merge_by_their_points(spark):
    rows = [(9, 0, 0, "wood", "forest", "osm", p, 9) for p in (10, 20, 400)] + [(11, 0, 0, "wood", "forest", "osm", p, 9) for p in (10, 20, 400)] + [(6, 0, 0, "sand", "dune", "osm", 1, 1), (6, 0, 0, "ice", "glacier", "glaciers", 1, 1)]
    got = landcover.merge(spark.createDataFrame(rows, "z int, x long, y long, class string, subclass string, source string, points long, pixels int"))
    assert sorted((r["z"], r["parts"]) for r in got.collect()) == [(6, 1), (9, 1), (9, 2), (11, 1), (11, 2)]
