"""Request logs: gate, token bucket, resolution, counters, and the queue of bundles to build."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import gates as G
from tilewright.sources.scratch import commit

# Token amounts are held as whole millionths, so that batch, stream and SQL agree to the last unit.
UNIT = 1_000_000

# Counter names by kind and outcome. "pass" counts requests of a log that was only gated.
COUNTERS = {
    "coarse:blocked": ["mapapi_coarse_blocked_total"], "coarse:empty": ["mapapi_coarse_empty_total"], "coarse:error": ["mapapi_coarse_error_total"], "coarse:ok": ["mapapi_coarse_ok_total"],
    "coarse:inflated": ["mapapi_coarse_ok_total", "mapapi_coarse_upstream_gzip_total", "mapapi_coarse_inflated_total"],
    "terrain:blocked": ["mapapi_terrain_blocked_total"], "terrain:empty": ["mapapi_terrain_empty_total"], "terrain:error": ["mapapi_terrain_error_total"], "terrain:ok": ["mapapi_terrain_ok_total"],
    "bundle1:ok": ["mapapi_bundle_ok_total"], "bundle1:cached": ["mapapi_bundle_cache_hit_total"], "bundle1:error": ["mapapi_bundle_error_total"],
    "bundle2:ok": ["mapapi_bundle_ok_total"], "bundle2:cached": ["mapapi_bundle_cache_hit_total"], "bundle2:error": ["mapapi_bundle_error_total"],
    "bundle3:ok": ["mapapi_bundle_v3_total", "mapapi_bundle_ok_total"], "bundle3:cached": ["mapapi_bundle_v3_total", "mapapi_bundle_cache_hit_total"],
    "bundle3:error": ["mapapi_bundle_v3_total", "mapapi_bundle_error_total"],
    "terrain_bundle:ok": ["mapapi_terrain_bundle_ok_total"], "terrain_bundle:error": ["mapapi_terrain_error_total"],
    "coarse:pass": ["mapapi_coarse_ok_total"], "terrain:pass": ["mapapi_terrain_ok_total"], "bundle1:pass": ["mapapi_bundle_ok_total"], "bundle2:pass": ["mapapi_bundle_ok_total"],
    "bundle3:pass": ["mapapi_bundle_v3_total"], "terrain_bundle:pass": ["mapapi_terrain_bundle_ok_total"],
}


def parse(log: DataFrame) -> DataFrame:
    """The log (event_id, ms, peer, method, target, body_length and others) with client, kind, z, x, y, extra and refused in their place.

    Nothing is judged: z, x and y are texts. extra says that there is a query or a body.
    """
    others = [c for c in log.columns if c not in ("event_id", "ms", "peer", "method", "target", "body_length")]
    extra = F.contains("target", F.lit("?")) | (F.coalesce("body_length", F.lit(0)) != 0)
    path = F.substring_index("target", "?", 1)
    cut = log.select("event_id", "ms", G.client_of(F.col("peer")).alias("client"), "method", path.alias("_path"), F.split(path, "/").alias("_parts"), extra.alias("extra"), *others)
    parts, n = F.col("_parts"), F.size("_parts")
    at = lambda k: F.get(parts, n - k)
    last = cut.select("event_id", "ms", "client", "method", G.kind_of(F.col("_path"), parts).alias("kind"), F.array(at(3), at(2), at(1)).alias("_three"), "extra", *others)
    bundle = F.contains("kind", F.lit("bundle"))
    value = lambda raw, deep: F.when(F.col("kind") != "service", G.path_value(F.when(bundle, F.col("_three")[deep]).otherwise(F.col("_three")[raw])))
    row = F.struct("event_id", "ms", "client", "kind", value(0, 2).alias("z"), value(1, 0).alias("x"), value(2, 1).alias("y"), "extra", G.refusal(F.col("method"), F.col("kind")).alias("refused"), *others)
    # a row by way of inline, or the optimizer would put these expressions into every place where the gates name them
    return last.select(F.inline(F.array(row)))


def gate(requests: DataFrame, terrain_zoom: int | None = 12) -> DataFrame:
    """Adds outcome and status; x and y become null on every row that does not pass. terrain_zoom is null if no archive is installed."""
    z, x, y, kind = F.col("z"), F.col("x"), F.col("y"), F.col("kind")
    deepest = F.lit(terrain_zoom).cast("int")
    outcome = F.when(F.col("refused").isNotNull(), F.col("refused")) if "refused" in requests.columns else F.when(F.lit(False), "")
    outcome = (
        outcome.when(kind == "coarse", G.gate_coarse(z, x, y)).when(kind == "terrain", G.gate_coarse(z, x, y, deepest))
        .when(kind == "terrain_bundle", G.gate_terrain_bundle(z, x, y, deepest)).otherwise(G.gate_bundle(z, x, y, F.col("extra")))
    )
    out = requests.withColumn("outcome", outcome).withColumn("status", G.status(F.col("outcome")))
    passed = F.col("outcome") == G.PASS
    return out.withColumn("z", G.integer(z)).withColumn("x", F.when(passed, G.integer(x))).withColumn("y", F.when(passed, G.integer(y)))


class Bucket:
    """Tokens and clock of one client; without tokens the state is unknown until an idle time refills it."""

    def __init__(self, rate: int, burst: int, tokens: int | None, last: int | None):
        self.rate, self.burst, self.tokens, self.last = rate, burst, tokens, last

    def take(self, ms: int, cost: int) -> bool | None:
        """Whether the request is allowed; null if that hangs on what came before."""
        if self.last is not None and ms > self.last:
            refill = (ms - self.last) * self.rate
            self.tokens = self.burst if refill >= self.burst else None if self.tokens is None else min(self.burst, self.tokens + refill)
        self.last = ms if self.last is None else max(self.last, ms)
        if self.tokens is None:
            return None
        allowed = self.tokens >= cost * UNIT
        self.tokens -= cost * UNIT if allowed else 0
        return allowed


def folded(requests: DataFrame, rate: int, burst: int) -> DataFrame:
    """requests (client, ms, event_id, cost and others) with allowed: a fold over each client's requests in the order (ms, event_id).

    The log is dealt out by range, so a client may span many tasks. A task does not know the bucket of its first
    client, but an idle time long enough to fill it tells: only the rows before the first such time are left
    over. These, with the states that ranges end in, are folded by client as a stream afterwards.
    """
    names = requests.columns
    dealt = requests.repartitionByRange("client", "ms", "event_id").sortWithinPartitions("client", "ms", "event_id")
    schema = T.StructType([*dealt.schema.fields, *T.StructType.fromDDL("allowed boolean, _range int, _tokens long, _last long").fields])

    def ranges(batches):
        at, now, bucket, before = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            clients, times, costs = (b.column(c).to_pylist() for c in ("client", "ms", "cost"))
            allowed = []
            for client, ms, cost in zip(clients, times, costs, strict=True):
                if bucket is None:
                    now, bucket = client, Bucket(rate, burst, None, None)
                elif client != now:
                    now, bucket = client, Bucket(rate, burst, burst, None)
                allowed.append(bucket.take(ms, cost))
            n = b.num_rows
            out = [*b.columns, pa.array(allowed, pa.bool_()), pa.array([at] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            batch = pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "allowed", "_range", "_tokens", "_last"])
            if before is not None:
                yield before
            before = batch
        if before is not None:
            # the state after a range goes with its last row
            n = before.num_rows
            mark = lambda v: pa.array([None] * (n - 1) + [v], pa.int64())
            yield before.set_column(before.num_columns - 2, "_tokens", mark(bucket.tokens)).set_column(before.num_columns - 1, "_last", mark(bucket.last))

    first = commit(dealt.mapInArrow(ranges, schema), "folded")
    left = first.where("allowed is null").select(*names, "_range", F.lit(0).alias("_end"), F.lit(None).cast("long").alias("_tokens"), F.lit(None).cast("long").alias("_last"))
    ends = first.where("_tokens is not null").select(*names, "_range", F.lit(1).alias("_end"), "_tokens", "_last")
    seams = left.select("client").distinct().join(ends, "client").select(left.columns)
    second = left.unionByName(seams).repartition("client").sortWithinPartitions("client", "_range", "_end", "ms", "event_id")

    def heads(batches):
        now, bucket = None, None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("client", "ms", "cost", "_end", "_tokens", "_last")]
            allowed = []
            for client, ms, cost, end, tokens, last in zip(*columns, strict=True):
                if bucket is None or client != now:
                    now, bucket = client, Bucket(rate, burst, burst, None)
                if end:
                    bucket.tokens, bucket.last = tokens, last
                    allowed.append(None)
                else:
                    allowed.append(bucket.take(ms, cost))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(allowed, pa.bool_())], names=[*names, "allowed"]).filter(pa.compute.equal(b.column("_end"), 0))

    late = second.mapInArrow(heads, T.StructType([*dealt.schema.fields, T.StructField("allowed", T.BooleanType())]))
    return first.where("allowed is not null").select(*names, "allowed").unionByName(late)


def token_bucket(requests: DataFrame, rate: int, burst: int) -> DataFrame:
    """client, event_id, allowed of requests with client (of any type), ms, event_id and cost (tokens).

    rate and burst are in units of a token (rate: a millisecond). A bucket starts full; it refills by elapsed time up to
    burst, and a request is allowed if it holds its cost, which is taken only then.
    """
    rows = requests.select("client", *[F.col(c).cast("long").alias(c) for c in ("ms", "event_id", "cost")])
    return folded(rows, rate, burst).select("client", "event_id", "allowed")


def holding(tiles: DataFrame) -> DataFrame:
    """z, x, y of the tiles (z, x, y, payload) that hold bytes, each once; without a payload all do."""
    return (tiles.where(F.octet_length("payload") > 0) if "payload" in tiles.columns else tiles).select("z", "x", "y").distinct()


def answer(requests: DataFrame, tiles: DataFrame, rate: int, burst: int, terrain_zoom: int | None = 12) -> DataFrame:
    """The gated log with the outcome and status of every request: gate, then bucket at the real cost, then tile.

    Only requests that pass the gate pay. A raw tile is ok (200) or empty (204), a vector bundle ok or, if it was
    given before, cached (200); a request that the bucket refuses is limited (429). Rows that are refused take part in no join.
    """
    gated = commit(gate(requests, terrain_zoom), "gated")
    names = gated.columns
    passed = F.col("outcome") == G.PASS
    paid = folded(gated.where(passed).withColumn("cost", G.request_cost(F.col("kind"), F.col("z"))), rate, burst)
    done = gated.where(~passed).unionByName(paid.where("not allowed").select(*names).withColumns({"outcome": F.lit("limited"), "status": F.lit(429)}))
    given, raw = paid.where("allowed").select(*names), F.col("kind").isin("coarse", "terrain")
    have = holding(tiles).withColumn("_have", F.lit(True))
    found = given.where(raw).join(have, ["z", "x", "y"], "left").withColumn("outcome", F.when(F.col("_have"), "ok").otherwise("empty"))
    found = found.withColumn("status", F.when(F.col("_have"), 200).otherwise(204))
    bundles = given.where(~raw).withColumn("status", F.lit(200))
    first = bundles.where(F.col("kind") != "terrain_bundle").groupBy("kind", "z", "x", "y").agg(F.min(F.struct("ms", "event_id")).alias("_first"))
    again = F.col("_first") < F.struct("ms", "event_id")
    bundles = bundles.join(first, ["kind", "z", "x", "y"], "left").withColumn("outcome", F.when(again, "cached").otherwise("ok"))
    return done.unionByName(found.select(*names)).unionByName(bundles.select(*names))


def resolve(gated: DataFrame, tiles: DataFrame) -> DataFrame:
    """Adds result to passed raw requests: ok or empty, by whether the tile exists and holds bytes."""
    have = tiles.where(F.octet_length("payload") > 0).select(F.col("z").alias("tz"), F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    raw = gated.where(F.col("kind").isin("coarse", "terrain") & (F.col("outcome") == G.PASS))
    same = (F.col("z") == F.col("tz")) & (F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty"))
    return raw.join(have, same, "left").withColumn("result", F.when(F.col("tz").isNotNull(), "ok").otherwise("empty")).drop("tz", "tx", "ty")


def metrics(judged: DataFrame, *others: str) -> DataFrame:
    """A row (metric and others) for each counter that a row of a gated or an answered log adds to."""
    names = F.create_map(*[x for k, v in COUNTERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return judged.select(F.explode(F.try_element_at(names, F.concat_ws(":", "kind", "outcome"))).alias("metric"), *others)


def counters(judged: DataFrame) -> DataFrame:
    """metric, value: counters by name, without coordinates, of a gated or an answered log."""
    return metrics(judged).groupBy("metric").agg(F.count("*").alias("value"))


def stages_of(requests: DataFrame, version: int, zoom: str = "z") -> DataFrame:
    """Rows for the stages of a bundle request: stage_ord, stage_zoom, part (0 full, 1 structure, 2 labels)."""
    z = F.col(zoom)
    stage = lambda k, zz, p: F.struct(F.lit(k).alias("stage_ord"), zz.cast("int").alias("stage_zoom"), F.lit(p).alias("part"))
    one = F.array(stage(0, z, 0))
    deep = F.array(stage(0, F.lit(13), 0), stage(1, F.lit(14), 0)) if version == 2 else F.array(stage(0, F.lit(13), 0), stage(1, F.lit(14), 1), stage(2, F.lit(14), 2))
    return requests.withColumn("_s", F.explode(F.when(z == 14, deep).otherwise(one))).select(*requests.columns, "_s.*")


def build_queue(gated: DataFrame, built: DataFrame, codec: str, version: str, digest: str) -> DataFrame:
    """Distinct stages that were asked for and are not built under the same key."""
    asked = stages_of(gated.where((F.col("kind") == "bundle3") & (F.col("outcome") == G.PASS)), 3)
    key = G.representation_key(codec, F.lit(version), F.lit(digest), F.col("x"), F.col("y"), F.col("stage_zoom"), F.col("part").cast("string"), F.lit("stage"))
    wanted = asked.select(key.alias("key"), F.col("x").alias("x10"), F.col("y").alias("y10"), "stage_zoom", "part").dropDuplicates(["key"])
    return wanted.join(built.select("key"), "key", "left_anti")
