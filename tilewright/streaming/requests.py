"""Request streams: a stateful token bucket, whole answers with running counters, and a queue of builds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tilewright.operators import requests as R

#: Clients are folded by shards, each one state: few calls of Python, and a small state to write again.
SHARDS = 1024


class TokenBucket(StatefulProcessor):
    """The buckets of a shard of clients: tokens and clock of each. Rows of a micro-batch are taken in order of time; the columns named are given back.

    A shard is one call and one state, as a call for each client would cost more than its requests. With a time to live, a
    timer of event time drops clients that have been idle for longer, which loses nothing as long as a full refill
    takes no longer: init raises otherwise.
    """

    def __init__(self, rate: int, burst: int, ttl_ms: int | None = None, columns: tuple[str, ...] = ("client", "event_id"), client: str = "string"):
        if ttl_ms is not None and burst > rate * ttl_ms:
            raise ValueError("a dropped bucket would not have been full")
        self.rate, self.burst, self.ttl_ms, self.columns, self.client = rate, burst, ttl_ms, [*columns, "allowed"], client

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", f"client array<{self.client}>, tokens array<long>, last array<long>")

    def held(self) -> dict:
        return {c: R.Bucket(self.rate, self.burst, tokens, last) for c, tokens, last in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def hold(self, buckets: dict) -> None:
        if buckets:
            self.state.update((list(buckets), [b.tokens for b in buckets.values()], [b.last for b in buckets.values()]))
        else:
            self.state.clear()
        if self.ttl_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if buckets:
                self.handle.registerTimer(min(b.last for b in buckets.values()) + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["ms", "event_id"], kind="stable")
        buckets, allowed = self.held(), []
        for client, ms, cost in zip(*(frame[c].tolist() for c in ("client", "ms", "cost")), strict=True):
            if client not in buckets:
                buckets[client] = R.Bucket(self.rate, self.burst, self.burst, None)
            allowed.append(buckets[client].take(ms, cost))
        self.hold(buckets)
        frame["allowed"] = allowed
        yield frame[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.hold({c: b for c, b in self.held().items() if b.last + self.ttl_ms > now})
        yield from ()

    def close(self) -> None:
        pass


class FirstOfPlace(StatefulProcessor):
    """Says how many of the requests (n) for a place (the key and slot) are the first for it, and how many come again.

    The state of a key has a bit for each slot that has come. A slot below 0 is no place, and its requests are all first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(self.seen.get()[0], np.uint8)) if self.seen.exists() else np.zeros(0, np.uint8)
        for frame in rows:
            slot, n = frame["slot"].to_numpy(), frame["n"].to_numpy()
            bits = np.pad(bits, (0, max(0, int(slot.max()) + 1 - len(bits))))
            new = np.unique(slot, return_index=True)[1]
            new = new[slot[new] >= 0]
            new = new[bits[slot[new]] == 0]
            bits[slot[new]] = 1
            first = np.where(slot < 0, n, 0)
            first[new] = 1
            yield frame.assign(first=first, again=n - first)
        if len(bits):
            self.seen.update((np.packbits(bits).tobytes(),))

    def close(self) -> None:
        pass


class RunningTotal(StatefulProcessor):
    """The total of a metric (metric, n) after each micro-batch that adds to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "value long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = (self.total.get()[0] if self.total.exists() else 0) + sum(int(frame["n"].sum()) for frame in rows)
        self.total.update((total,))
        yield pd.DataFrame({"metric": [key[0]], "value": [total]})

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time)


def ddl(stream: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)


def tallied(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (columns, n) with n summed up by the columns inside each task, before they are dealt out."""
    rows = rows.select(*columns, "n")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(columns).aggregate([("n", "sum")]).select([*columns, "n_sum"]).rename_columns(b.schema.names).to_batches()

    return rows.mapInArrow(sums, rows.schema)


def bucketed(stream: DataFrame, columns: list[str], rate: int, burst: int, ttl_ms: int | None = None) -> DataFrame:
    """columns and allowed of a stream (client, ms, event_id, cost and others): clients are folded shard by shard."""
    rows = stream.withColumn("shard", F.pmod(F.hash("client"), F.lit(SHARDS)))
    client = stream.schema["client"].dataType.simpleString()
    return keyed(rows, ["shard"], TokenBucket(rate, burst, ttl_ms, tuple(columns), client), f"{ddl(rows, columns)}, allowed boolean", "None" if ttl_ms is None else "EventTime")


def token_bucket(stream: DataFrame, rate: int, burst: int, ttl_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """client, event_id, allowed of a stream (client of any type that Python can hash, ms, event_id, cost): as the batch fold when rows arrive in order of time.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). With a time to live, idle clients are
    dropped by event time, once the watermark (ms, `delay` behind) has passed it.
    """
    rows = stream.select("client", *[F.col(c).cast("long").alias(c) for c in ("ms", "event_id", "cost")])
    if ttl_ms is not None:
        rows = rows.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", delay)
    return bucketed(rows, ["client", "event_id"], rate, burst, ttl_ms)


def first_of_place(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, first, again of a stream of requests (keys, x, y and n of them): how many are the first for their bundle, and how many come again.

    Bundles meet in strips of 32 columns of the map; an x below 0 is no bundle.
    """
    place = F.shiftleft("x", R.G.ANCHOR_ZOOM) + F.col("y")
    strip = rows.select(*keys, F.shiftright(place, 15).alias("strip"), F.when(F.col("x") < 0, -1).otherwise(place % (1 << 15)).alias("slot"), "n")
    strip = tallied(strip, [*keys, "strip", "slot"])
    out = keyed(strip, [*keys, "strip"], FirstOfPlace(), f"{ddl(strip, strip.columns)}, first long, again long")
    place = F.shiftleft("strip", 15) + F.col("slot")
    return out.select(*keys, F.shiftright(place, R.G.ANCHOR_ZOOM).alias("x"), (place % (1 << R.G.ANCHOR_ZOOM)).alias("y"), "first", "again")


def answered(stream: DataFrame, tiles: DataFrame, rate: int, burst: int, terrain_zoom: int | None = 12) -> DataFrame:
    """kind, outcome, n: how many requests of a parsed stream operators.requests.answer() gives an outcome. Gate, bucket, tile, first of its kind.

    tiles (z, x, y, payload; without payload, all hold bytes) are read once a micro-batch. The states are keyed by shards of clients and by strips of
    bundles; requests that the gate settles wait for no later step.
    """
    # a row by way of inline: the optimizer keeps the gates in one place
    gated = R.gate(stream, terrain_zoom).select(F.inline(F.array(F.struct("client", "ms", "event_id", "kind", "z", "x", "y", "outcome"))))
    passed, raw = F.col("outcome") == R.G.PASS, F.col("kind").isin("coarse", "terrain")
    refused = tallied(gated.where(~passed).withColumn("n", F.lit(1).cast("long")), ["kind", "outcome"])
    # the gate lets raw tiles pass to zoom 10 only: at most 1,398,101 places, a number each
    place = lambda z, x, y: F.shiftleft(F.col(z).cast("long"), 40) + F.shiftleft(F.col(x).cast("long"), 20) + F.col(y)
    have = R.holding(tiles).where((F.col("z") <= R.G.ANCHOR_ZOOM) & R.G.valid_xyz(F.col("z"), F.col("x"), F.col("y"))).select(place("z", "x", "y").alias("_place"), F.lit(True).alias("_have")).distinct()
    found = gated.where(passed).withColumn("_place", F.when(raw, place("z", "x", "y"))).join(F.broadcast(have), "_place", "left")
    # bundles meet by place; what else is allowed has its outcome
    meets = ~raw & (F.col("kind") != "terrain_bundle")
    cost, given = R.G.request_cost(F.col("kind"), F.col("z")), F.when(raw & F.col("_have").isNull(), "empty").otherwise("ok")
    paid = found.select("client", "ms", "event_id", "kind", cost.alias("cost"), given.alias("outcome"), *[F.when(meets, F.col(c)).otherwise(-1).alias(c) for c in ("z", "x", "y")])
    paid = bucketed(paid, ["kind", "outcome", "z", "x", "y"], rate, burst)
    allowed = F.col("allowed")
    rows = paid.select("kind", F.when(allowed, F.col("outcome")).otherwise("limited").alias("outcome"), *[F.when(allowed, F.col(c)).otherwise(-1).alias(c) for c in ("z", "x", "y")], F.lit(1).cast("long").alias("n"))
    first = first_of_place(rows, ["kind", "outcome", "z"])
    both = F.array(F.struct("kind", "outcome", F.col("first").alias("n")), F.struct("kind", F.lit("cached").alias("outcome"), F.col("again").alias("n")))
    return first.select(F.inline(both)).where("n > 0").unionByName(refused)


def counters(stream: DataFrame, tiles: DataFrame, rate: int, burst: int) -> DataFrame:
    """metric, value: the totals of all counters a micro-batch adds to, in append mode; the largest value of a metric is its last."""
    # counted before they are dealt out: a metric is a few rows of each task
    metrics = tallied(R.metrics(answered(stream, tiles, rate, burst), "n"), ["metric"])
    return keyed(metrics, ["metric"], RunningTotal(), "metric string, value long")


def build_queue(stream: DataFrame, codec: str, version: str, digest: str) -> DataFrame:
    """Stages asked for by a parsed stream, each key once for all time: what is built is state, a bit for each place of a representation."""
    asked = R.stages_of(R.gate(stream).where("kind = 'bundle3' and outcome = 'pass'"), 3)
    new = first_of_place(asked.withColumn("n", F.lit(1).cast("long")), ["stage_zoom", "part"]).where("first > 0")
    key = R.G.representation_key(codec, F.lit(version), F.lit(digest), F.col("x"), F.col("y"), F.col("stage_zoom"), F.col("part").cast("string"), F.lit("stage"))
    return new.select(key.alias("key"), F.col("x").alias("x10"), F.col("y").alias("y10"), "stage_zoom", "part")


def drain(stream: DataFrame, path: str, into: Callable[[DataFrame, int], None], checkpoint: str = "checkpoint", partitions: int | None = None) -> StreamingQuery:
    """Run a stream over all that is there now, with its checkpoint beside the output. Returns the query, ended.

    The state has as many partitions as the session's shuffles, or fewer if partitions says so: each is a store to open and to commit in every micro-batch.
    A checkpoint keeps the number it began with.
    """
    spark = stream.sparkSession
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(min(partitions, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kept = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode("append").foreachBatch(into).option("checkpointLocation", f"{path}/{checkpoint}").trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        for k, v in kept.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
