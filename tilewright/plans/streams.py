"""Queries of request streams: micro-batches of the request log in order of time, drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import requests as R
from tilewright.plans import fixtures as X
from tilewright.plans.requests import BURST, CODEC, DIGEST, RATE, SQL as BATCH, VERSION, have
from tilewright.sources.scratch import commit, scratch_path
from tilewright.streaming import requests as S

BATCHES = 3


def _drained(spark, d, name, job):
    """The folder of what a job makes of the request log: it arrives in order of time, in files of many tasks, and each arrival is a micro-batch."""
    path = scratch_path(spark, name)
    log = commit(R.parse(X.request_log(spark, d)).withColumn("ts", F.timestamp_millis("ms")), "log")
    bounds = log.agg(F.percentile_approx("ms", [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = log if lo is None else log.where(F.col("ms") >= lo)
        (part if hi is None else part.where(F.col("ms") < hi)).write.mode("append").parquet(f"{path}/in")
        S.drain(job(spark.readStream.schema(log.schema).parquet(f"{path}/in")), path, _into(path), partitions=spark.sparkContext.defaultParallelism)
    return path


def _table(spark, path, schema):
    return spark.read.schema(schema).parquet(f"{path}/out").drop("batch")


def _into(path):
    """Each micro-batch is a folder of its own, so one that runs again replaces what it wrote."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n:06d}")


def token_bucket_stream(spark, d):
    path = _drained(spark, d, "bucket", lambda source: S.token_bucket(source, RATE, BURST))
    return _table(spark, path, "client string, event_id long, allowed boolean")


def bucket_eviction(spark, d):
    """The same stream with idle clients dropped by event time: no decision changes."""
    path = _drained(spark, d, "evict", lambda source: S.token_bucket(source, RATE, BURST, ttl_ms=max(600_000, BURST // RATE)))
    return _table(spark, path, "client string, event_id long, allowed boolean")


def request_counters_stream(spark, d):
    tiles = commit(R.holding(have(spark, d)), "holding")  # once, not for each arrival
    path = _drained(spark, d, "counters", lambda source: S.counters(source, tiles, RATE, BURST))
    return _table(spark, path, "metric string, value long").groupBy("metric").agg(F.max("value").alias("value"))


def build_queue_stream(spark, d):
    path = _drained(spark, d, "queue", lambda source: S.build_queue(source, CODEC, VERSION, DIGEST))
    return _table(spark, path, "key string, x10 long, y10 long, stage_zoom int, part int")


QUERIES = {f.__name__: f for f in (token_bucket_stream, bucket_eviction, request_counters_stream, build_queue_stream)}
ASKED = BATCH["build_queue"].split("SELECT * FROM (SELECT DISTINCT")
SQL = {
    "token_bucket_stream": BATCH["token_bucket_batch"], "bucket_eviction": BATCH["token_bucket_batch"], "request_counters_stream": BATCH["request_counters"],
    "build_queue_stream": (ASKED[0] + "SELECT DISTINCT" + ASKED[1]).rsplit(") WHERE key NOT IN", 1)[0],
}
