"""Streams of requests: state that goes with the watermark, builds asked for once, answers as of the batch."""

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.operators import requests as R
from tilewright.plans import streams
from tilewright.streaming import requests as S

BUCKET = "client string, ms long, event_id long, cost long"
LOG = "event_id long, ms long, peer string, method string, target string, body_length long"


def arrive(spark, path, rows, schema):
    """Rows as one more file of a stream, read one file a micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def into(path):
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n:06d}")


def test_idle_state_goes_once_the_watermark_passes(spark, tmp_path):
    path, minute = str(tmp_path), 60_000
    rows = [(f"10.0.0.{i % 7}", 1_000_000 + i * 700, i, 1 + i % 3) for i in range(80)]
    for k in range(0, 80, 40):
        stream = arrive(spark, path, rows[k : k + 40], BUCKET)
    arrive(spark, path, [("later", 1_000_000 + 30 * minute, 900, 1)], BUCKET)
    arrive(spark, path, [("later", 1_000_000 + 31 * minute, 902, 1)], BUCKET)
    arrive(spark, path, [("10.0.0.1", 1_000_000, 901, 1), ("later", 1_000_000 + 32 * minute, 903, 1)], BUCKET)
    query = S.drain(S.token_bucket(stream, 100, 4 * R.UNIT, ttl_ms=10 * minute), path, into(path))
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{path}/out").collect()}
    want = {r["event_id"]: r["allowed"] for r in R.token_bucket(spark.createDataFrame(rows, BUCKET), 100, 4 * R.UNIT).collect()}
    assert {i: got[i] for i in want} == want and False in want.values() and set(got) == {*want, 900, 902, 903}  # 901 was too late
    assert max(held) >= 7 and held[-1] < 7
    with pytest.raises(ValueError):
        S.TokenBucket(1, 1000, ttl_ms=999)


def test_a_build_is_asked_for_once(spark, tmp_path):
    path = str(tmp_path)
    ask = lambda i, x, z: (i, 1000 * i, "h:1", "GET", f"/planet/bundle/v3/{x}/2/{z}", 0)
    source = arrive(spark, path, [ask(0, 1, 14), ask(1, 1, 14), ask(2, 2, 11), ask(3, 1, 99)], LOG)
    arrive(spark, path, [ask(4, 2, 11), ask(5, 1, 13)], LOG)
    queue = lambda: S.build_queue(R.parse(source), "c", "v", "d")
    S.drain(queue(), path, into(path))
    assert sorted((r["stage_zoom"], r["part"]) for r in spark.read.parquet(f"{path}/out").collect()) == [(11, 0), (13, 0), (14, 1), (14, 2)]
    arrive(spark, path, [ask(6, 1, 14), ask(7, 3, 12)], LOG)
    S.drain(queue(), path, into(path))
    keys = [r["key"] for r in spark.read.parquet(f"{path}/out").collect()]
    assert len(keys) == len(set(keys)) == 5
    # the same batches once more, over what they wrote: nothing changes
    S.drain(queue(), path, into(path), checkpoint="again")
    assert sorted(r["key"] for r in spark.read.parquet(f"{path}/out").collect()) == sorted(keys)


def test_answers_of_a_stream_equal_the_batch(spark, tmp_path):
    path, kinds = str(tmp_path), ["/planet/5/1/{}", "/planet/bundle/v3/1/{}/12", "/terrain/bundle/v1/1/{}/12", "/planet/bundle/v2/1/{}/14", "/planet/12/1/{}", "/terrain/5/1/{}"]
    rows = [(i, 50 * i, f"10.0.0.{i % 3}:1", "GET" if i % 17 else "POST", kinds[i % 6].format(i % 4), i % 19 // 18) for i in range(240)]
    tiles = spark.createDataFrame([(5, 1, 1, b"x"), (5, 1, 2, b"")], "z int, x long, y long, payload binary")
    for k in range(0, 240, 80):
        source = arrive(spark, path, rows[k : k + 80], LOG)
    S.drain(S.counters(R.parse(source), tiles, 4000, 6 * R.UNIT), path, into(path))
    got = {r["metric"]: r["value"] for r in spark.read.parquet(f"{path}/out").groupBy("metric").agg(F.max("value").alias("value")).collect()}
    batch = R.answer(R.parse(spark.createDataFrame(rows, LOG)), tiles, 4000, 6 * R.UNIT)
    assert got == {r["metric"]: r["value"] for r in R.counters(batch).collect()}
    assert {r["outcome"] for r in batch.collect()} >= {"limited", "cached", "ok", "empty", "bad_method", "extra", "blocked"}


def test_arrivals_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    """A micro-batch is as many files as there are tasks, yet one batch; none goes through a single task."""
    rows = [(i, 1000 * i, "h:1", "GET", f"/planet/bundle/v3/{i % 5}/2/14", 0) for i in range(300)]
    monkeypatch.setattr(streams.X, "request_log", lambda *_: spark.createDataFrame(rows, LOG).repartition(8))
    monkeypatch.setattr(streams, "scratch_path", lambda *_: str(tmp_path / "queue"))
    found = streams.build_queue_stream(spark, "")
    assert found.count() == 15 and len(list((tmp_path / "queue" / "in").glob("part-*"))) > 2 * streams.BATCHES


def test_totals_come_from_counts_of_tasks(spark, tmp_path):
    rows = [(i, i, f"h{i}:1", "GET" if i % 2 else "POST", "/planet/5/1/1", 0) for i in range(40)]
    source = arrive(spark, str(tmp_path), rows, LOG)
    tiles = spark.createDataFrame([(5, 1, 1, b"x")], "z int, x long, y long, payload binary")
    S.drain(S.counters(R.parse(source), tiles, 1, R.UNIT), str(tmp_path), into(str(tmp_path)))
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("mapapi_coarse_ok_total", 20)]


class Held:
    """The state of one key and its timers, without a stream."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.exists, self.get, self.update, self.clear = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v), lambda: setattr(self, "value", None)
        self.getValueState, self.listTimers, self.registerTimer, self.deleteTimer = lambda *_: self, lambda: self.timers, self.timers.add, self.timers.discard
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: min(self.timers)


def test_a_place_is_first_once_whatever_the_frames(spark):
    held, step = Held(), S.FirstOfPlace()
    step.init(held)

    def firsts(*frames):
        rows = pd.concat(step.handleInputRows(("k",), (pd.DataFrame(f, columns=["slot", "n"]) for f in frames), None))
        return list(rows[["slot", "first", "again"]].itertuples(index=False, name=None))

    assert firsts([(-1, 5), (-1, 2)]) == [(-1, 5, 0), (-1, 2, 0)] and not held.exists()
    assert firsts([(9, 3), (0, 1), (9, 2)], [(9, 1), (40, 2), (-1, 4)]) == [(9, 1, 2), (0, 1, 0), (9, 0, 2), (9, 0, 1), (40, 1, 1), (-1, 4, 0)]
    assert firsts([(40, 1), (1, 1), (32767, 2)]) == [(40, 0, 1), (1, 1, 0), (32767, 1, 1)]


def test_clients_of_a_shard_go_one_by_one(spark):
    held, step = Held(), S.TokenBucket(1, 10, ttl_ms=10)
    step.init(held)
    frame = pd.DataFrame([("a", 1, 5, 0), ("b", 2, 3, 0), ("a", 3, 8, 0), (None, 4, 6, 0)], columns=["client", "event_id", "ms", "cost"])
    list(step.handleInputRows((0,), iter([frame]), held))
    assert dict(zip(held.value[0], held.value[2], strict=True)) == {"a": 8, "b": 3, None: 6} and held.timers == {13}
    for left in ({"a", None}, {"a"}, set()):
        list(step.handleExpiredTimer((0,), held, held))
        assert left == set(held.value[0] if held.exists() else [])
    assert not held.timers


def test_states_grow_by_shards_and_the_bucket_is_one_step(spark, tmp_path):
    """Many clients are few calls and few states, no step of a state runs twice, and the state has as many partitions as were asked for."""
    path, clients = str(tmp_path), S.SHARDS + 500
    rows = [(i, i, f"c{i % clients}:1", "GET", f"/planet/bundle/v{1 + i % 3}/{i * 7 % 300}/{i * 11 % 250}/{11 + i % 4}", 0) for i in range(2 * clients)]
    tiles = spark.createDataFrame([(5, 1, 1, b"x")], "z int, x long, y long, payload binary")
    source = arrive(spark, path, rows, LOG)
    query = S.drain(S.counters(R.parse(source), tiles, 1000, 20 * R.UNIT), path, into(path), partitions=2)
    states = query.lastProgress["stateOperators"]
    assert len(states) == 3 and max(o["numRowsTotal"] for o in states) <= S.SHARDS and {o["numShufflePartitions"] for o in states} == {2}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    got = {r["metric"]: r["value"] for r in spark.read.parquet(f"{path}/out").collect()}
    batch = R.answer(R.parse(spark.createDataFrame(rows, LOG)), tiles, 1000, 20 * R.UNIT)
    assert got == {r["metric"]: r["value"] for r in R.counters(batch).collect()} and "mapapi_bundle_cache_hit_total" in got


def test_tiles_are_read_once_for_all_arrivals(spark, monkeypatch, tmp_path):
    read, path = spark.sparkContext.accumulator(0), itertools.count()

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, 1000 * i, f"h{i}:1", "GET", f"/planet/8/{i % 5}/2", 0) for i in range(30)]
    tiles = spark.createDataFrame([(8, x, 2, b"x") for x in range(3)], "z int, x long, y long, payload binary")
    monkeypatch.setattr(streams.X, "request_log", lambda *_: spark.createDataFrame(rows, LOG))
    monkeypatch.setattr(streams, "have", lambda *_: tiles.mapInArrow(seen, tiles.schema))
    monkeypatch.setattr(streams, "scratch_path", lambda *_: str(tmp_path / f"{next(path)}"))
    found = {r["metric"]: r["value"] for r in streams.request_counters_stream(spark, "").collect()}
    assert found == {"mapapi_coarse_ok_total": 18, "mapapi_coarse_empty_total": 12} and read.value == 3
