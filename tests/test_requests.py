import pytest
from pyspark.sql import functions as F

from tilewright.functions import gates as G
from tilewright.operators import blocks, catalog, directories, pyramid
from tilewright.operators import requests as R
from tilewright.streaming.requests import TokenBucket

CASES = [
    ("coarse", "9", "1", "1", False, "pass"), ("coarse", "11", "x", "y", False, "blocked"), ("coarse", "1.5", "0", "0", False, "bad_zoom"), ("coarse", "3", "8", "0", False, "range"), ("coarse", "+3", "a", "0", False, "bad_tile"),
    ("bundle3", "14", "1023", "0", False, "pass"), ("bundle3", "14", "1024", "0", False, "invalid"), ("bundle2", "10", "1", "1", False, "invalid"), ("bundle2", "12", "1", "1", True, "extra"), ("bundle3", "12", "", "1", False, "bad_path"),
    ("terrain_bundle", "11", "0", "0", True, "pass"), ("terrain_bundle", "12", "0", "0", False, "pass"), ("terrain_bundle", "10", "0", "0", False, "range"), ("terrain_bundle", "13", "0", "0", False, "range"), ("terrain", "-1", "0", "0", False, "blocked"),
    ("coarse", None, "0", "0", False, "bad_zoom"), ("coarse", "99999999999999999999", "0", "0", False, "bad_zoom"),
]


def test_gates(spark):
    df = spark.createDataFrame(CASES, "kind string, z string, x string, y string, extra boolean, want string")
    for r in R.gate(df).collect():
        assert r["outcome"] == r["want"], r
        assert (r["x"] is None) == (r["outcome"] != "pass")


def test_path_escape(spark):
    out = spark.range(1).select(G.path_escape(F.lit("2026 01/a*b~$&+:=@é"))).first()[0]
    assert out == "2026%2001%2Fa%2Ab~$&+:=@%C3%A9"


def test_token_bucket_arithmetic(spark):
    rows = [(1, 1, 0, 2), (1, 2, 0, 1), (1, 3, 1000, 1), (1, 4, 500, 1), (1, 5, 9000, 3)]
    df = spark.createDataFrame(rows, "client long, event_id long, ms long, cost long")
    got = {r["event_id"]: r["allowed"] for r in R.token_bucket(df, rate=1000, burst=2 * R.UNIT).collect()}
    # two tokens; a token a second; rows in the order of time
    assert got == {1: True, 2: False, 4: False, 3: True, 5: False}


def test_token_bucket_equals_a_plain_fold(spark):
    import random

    r = random.Random(4)
    rows, ms = [], 0
    for i in range(600):
        ms += r.choice([0, 1, 40, 400, 2500])
        rows.append((i % 3, i, ms - r.choice([0, 0, 30]), r.choice([1, 1, 2, 3])))
    want = {}
    for client in range(3):
        tokens, last = 2 * R.UNIT, None
        for _, i, at, cost in sorted((x for x in rows if x[0] == client), key=lambda x: (x[2], x[1])):
            if last is not None and at > last:
                tokens = min(2 * R.UNIT, tokens + (at - last) * 1000)
            last = at
            want[i] = tokens >= cost * R.UNIT
            tokens -= cost * R.UNIT if want[i] else 0
    df = spark.createDataFrame(rows, "client long, event_id long, ms long, cost long")
    assert {x["event_id"]: x["allowed"] for x in R.token_bucket(df, rate=1000, burst=2 * R.UNIT).collect()} == want


def test_ttl_must_cover_a_refill():
    with pytest.raises(ValueError):
        TokenBucket(rate=1, burst=1000, ttl_ms=999)


def test_stages(spark):
    df = spark.createDataFrame([(14,), (12,)], "z long")
    assert sorted((r["z"], r["stage_zoom"], r["part"]) for r in R.stages_of(df, 3).collect()) == [(12, 12, 0), (14, 13, 0), (14, 14, 1), (14, 14, 2)]
    assert R.stages_of(df, 2).count() == 3


def test_pyramid_of_a_constant_is_constant(spark):
    px = spark.range(32 * 32).select(F.lit(2).alias("z"), (F.col("id") % 32).alias("gx"), F.floor(F.col("id") / 32).alias("gy"), F.lit(7).alias("metres"))
    rows = blocks.to_pixels(pyramid.pyramid(blocks.of_pixels(px, 8), 8), 8).groupBy("z").agg(F.count("*").alias("n"), F.min("metres").alias("lo"), F.max("metres").alias("hi")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 64, 7, 7), (1, 256, 7, 7), (2, 1024, 7, 7)]


def test_pyramid_rounds_half_even_and_counts_missing_as_zero(spark):
    px = spark.createDataFrame([(1, 0, 0, 10), (1, 2, 0, 14)], "z int, gx long, gy long, metres int")
    assert {(r["gx"], r["metres"]) for r in blocks.to_pixels(pyramid.level_up(blocks.of_pixels(px, 8), 8), 8).where("metres <> 0").collect()} == {(0, 2), (1, 4)}


LOG = "event_id long, ms long, peer string, method string, target string, body_length long"


def test_requests_as_they_arrive(spark):
    lines = [
        ("10.0.0.1:80", "GET", "/planet/9/1/2", 0, "coarse", "pass", 200), ("10.0.0.1:80", "HEAD", "/planet/9/1/2?v=1", 7, "coarse", "pass", 200), ("[fd00::1]:9", "GET", "/planet/11/private/1", 0, "coarse", "blocked", 404),
        ("fd00::1", "GET", "/planet/bundle/v3/1/2/14", 0, "bundle3", "pass", 200), ("10.0.0.1", "GET", "/planet/bundle/v3/1/2/14?", 0, "bundle3", "extra", 400), ("10.0.0.2:1", "GET", "/planet/bundle/v2/1/2/14", -1, "bundle2", "extra", 400),
        ("h:1", "OPTIONS", "/planet/bundle/v2/1/2/14", 0, "bundle2", "preflight", 204), ("h:1", "OPTIONS", "/planet/bundle/v1/1/2/14", 0, "bundle1", "bad_method", 405), ("h:1", "POST", "/terrain/3/1/1", 0, "terrain", "bad_method", 405),
        ("h:1", "GET", "/terrain/bundle/v1/3/1/12?x=1", 3, "terrain_bundle", "pass", 200), ("h:1", "GET", "/terrain/bundle/v2/3/1/12", 0, None, "unrouted", 404), ("h:1", "GET", "/planet//1/1", 0, None, "unrouted", 404), ("h:1", "GET", "/metrics", 0, "service", "service", 200),
        ("h:1", "GET", "/planet/%39/+1/%2b2", 0, "coarse", "pass", 200), ("h:1", "GET", "/planet/bundle/v2/x", 0, "coarse", "bad_zoom", 400), ("h:1", "GET", "/planet/9/%zz/1", 0, "coarse", "bad_tile", 400), ("h:1", "GET", "/planet/9/512/1", 0, "coarse", "range", 404),
    ]
    log = spark.createDataFrame([(i, 1000 * i, *row[:4]) for i, row in enumerate(lines)], LOG)
    parsed = R.parse(log)
    assert {r["event_id"]: r["kind"] for r in parsed.collect()} == {i: row[4] for i, row in enumerate(lines)}
    assert {r["client"] for r in parsed.collect()} == {"10.0.0.1", "10.0.0.2", "fd00::1", "h"}
    assert {r["event_id"]: r["outcome"] for r in R.gate(parsed).collect()} == {i: row[5] for i, row in enumerate(lines)}
    tiles = spark.createDataFrame([(9, 1, 2, b"x")], "z int, x long, y long, payload binary")
    out = {r["event_id"]: r for r in R.answer(parsed, tiles, 1000, 100 * R.UNIT).collect()}
    assert {i: r["status"] for i, r in out.items()} == {i: row[6] for i, row in enumerate(lines)} and out[2]["x"] is None
    none = {r["event_id"]: r["status"] for r in R.answer(R.parse(log), tiles, 1000, 100 * R.UNIT, terrain_zoom=None).collect()}
    assert {i for i in none if none[i] != out[i]["status"]} == {9} and none[9] == 404


def test_a_busy_client_spans_tasks(spark):
    """A third of a log is one client's; its ranges are folded side by side, whether it pauses or never does."""
    import random

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(11)
    for pauses in (0.01, 0.0):
        rows, clock = [], {}
        for i in range(3000):
            client = "10.0.0.1" if i % 3 == 0 else f"10.0.1.{r.randrange(40)}"
            clock[client] = clock.get(client, 0) + (9000 if r.random() < pauses else r.choice([0, 5, 40, 300]))
            rows.append((client, clock[client], i, r.choice([1, 2, 3])))
        rows += [("10.0.0.1", 5, 4000 + k, 1) for k in range(3)] + [(None, 1, 5000, 1), (None, 1, 5001, 2)]
        state, want = {}, {}
        for client, ms, i, cost in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
            tokens, last = state.get(client, (2 * R.UNIT, ms))
            tokens = min(2 * R.UNIT, tokens + (ms - last) * 1000)
            want[i] = tokens >= cost * R.UNIT
            state[client] = (tokens - cost * R.UNIT * want[i], ms)
        df = spark.createDataFrame(rows, "client string, ms long, event_id long, cost long").repartition(8)
        got = R.folded(df, 1000, 2 * R.UNIT)
        assert {x["event_id"]: x["allowed"] for x in got.collect()} == want
        held = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()})
        assert held.where("client = '10.0.0.1'").select("_range").distinct().count() > 1
        if pauses:
            assert 0 < held.where("allowed is null").count() < 1500
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_covers_of_long_runs(spark):
    import random

    long = spark.createDataFrame([(3, 10**8, 5, "a"), (2 * 10**8, 1, 5, "b"), (1 << 40, 1 << 30, 5, "c")], "tile_id long, run long, length long, digest string")
    posted = directories.dyadic_cover(long)
    assert posted.count() < 60 and posted.groupBy("digest", "_level").count().agg(F.max("count")).first()[0] <= 2
    assert {tuple(r) for r in posted.groupBy("digest").agg(F.sum(F.expr("shiftleft(1L, _level)"))).collect()} == {("a", 10**8), ("b", 1), ("c", 1 << 30)}
    r = random.Random(3)
    entries, at = [], 0
    for k in range(200):
        at += r.choice([0, 0, 1, 5, 100])
        run = r.choice([1, 2, 3, 7, 64, 1000])
        entries.append((at, run, k, str(k)))
        at += run
    ids = [r.randrange(at + 50) for _ in range(500)] + [0, 0]
    want = sorted((i, next((e[3] for e in entries if e[0] <= i < e[0] + e[1]), "")) for i in ids)
    directory = spark.createDataFrame(entries, "tile_id long, run long, length long, digest string")
    got = directories.lookup(spark.createDataFrame([(i,) for i in ids], "tile_id long"), directory)
    assert sorted((x["tile_id"], x["digest"] or "") for x in got.collect()) == want
    assert directories.lookup(spark.createDataFrame([(5,)], "tile_id long"), directory.limit(0)).first()["digest"] is None
    spread = directories.expand_runs(directory, bits=3)
    assert sorted((x["tile_id"], x["digest"]) for x in spread.collect()) == sorted((e[0] + j, e[3]) for e in entries for j in range(e[1]))
    cut = directories.pieces(long, 16)
    assert cut.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] < 1 << 16 and cut.count() < 10**8 / 2**16 + 2**14 + 9


def test_runs_cross_ranges(spark):
    n = 1 << directories.RANGE_BITS
    ids = [(i, "a" if i < 2 * n + 5 else "b", 1) for i in range(n - 3, 2 * n + 9)]
    out = directories.run_length_directory(spark.createDataFrame(ids, "tile_id long, digest string, length long"))
    assert sorted((r["tile_id"], r["run"], r["digest"]) for r in out.collect()) == [(n - 3, n + 8, "a"), (2 * n + 5, 4, "b")]


def test_retention_keeps_the_active_one(spark):
    rows = [("d", str(i), i, i == 0) for i in range(5)]
    out = catalog.retention(spark.createDataFrame(rows, "dataset string, version string, mtime int, active boolean"), 2)
    assert {r["version"] for r in out.collect()} == {"0", "3", "4"}
