"""Queries of request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import gates as G
from tilewright.operators import requests as R
from tilewright.plans.fixtures import REQUESTS, TILES, releases, request_log, tiles, with_tables
from tilewright.sources import lines
from tilewright.sources.scratch import scratch_path

CODEC, VERSION, DIGEST = "spark-scb1gz-r1", "2026 01/a*b~$&+:=@", "d0"
RATE, BURST = 125, 16 * R.UNIT  # an eighth of a token a second


def _requests(spark, d):
    return R.parse(request_log(spark, d))


def scan_request_log(spark, d):
    """The log as it arrives, written, read back and parsed."""
    path = scratch_path(spark, "requests")
    request_log(spark, d).write.parquet(path)
    return R.parse(lines.request_log(spark, path))


def have(spark, d):
    return tiles(spark, d).where("payload is not null").select(F.lit(8).alias("z"), (F.col("x") % 256).alias("x"), (F.col("y") % 256).alias("y"), "payload")


def _answered(spark, d):
    return R.answer(_requests(spark, d), have(spark, d), RATE, BURST)


def _gated(spark, d, kind):
    return _answered(spark, d).where(F.col("kind").isin(kind)).select("event_id", "outcome", "status", "x", "y")


def gate_coarse(spark, d):
    return _gated(spark, d, ["coarse"])


def gate_bundle(spark, d):
    return _gated(spark, d, ["bundle1", "bundle2", "bundle3"])


def gate_terrain(spark, d):
    return _gated(spark, d, ["terrain", "terrain_bundle"])


def request_cost(spark, d):
    return R.gate(_requests(spark, d)).where("outcome = 'pass'").select("event_id", G.request_cost(F.col("kind"), F.col("z")).alias("tokens"))


def representation_key(spark, d):
    gated = R.gate(_requests(spark, d)).where("outcome = 'pass' and kind = 'bundle3'")
    return gated.select("event_id", G.representation_key(CODEC, F.lit(VERSION), F.lit(DIGEST), F.col("x"), F.col("y"), F.col("z")).alias("key"))


def etag_v1_terrain(spark, d):
    gated = R.gate(_requests(spark, d)).where("outcome = 'pass' and kind in ('bundle2', 'terrain_bundle')")
    args = (F.lit("v1"), F.col("x"), F.col("y"), F.col("z"))
    tag = F.when(F.col("kind") == "bundle2", G.etag(*args)).otherwise(G.etag(*args, prefix="terrain:"))
    seen = F.when(F.col("event_id") % 2 == 0, tag).otherwise(F.lit('"old"'))
    return gated.select("event_id", tag.alias("etag"), F.when(seen == tag, 304).otherwise(200).alias("status"))


def safe_version(spark, d):
    return releases(spark, d).select("seq", G.safe_version(F.col("version")).alias("safe"))


def expand_stages(spark, d):
    gated = R.gate(_requests(spark, d)).where("outcome = 'pass' and kind in ('bundle2', 'bundle3')")
    two, three = R.stages_of(gated.where("kind = 'bundle2'"), 2), R.stages_of(gated.where("kind = 'bundle3'"), 3)
    return two.unionByName(three).select("event_id", "stage_ord", "stage_zoom", "part")


def resolve_requests(spark, d):
    return R.resolve(R.gate(_requests(spark, d)), have(spark, d)).select("event_id", "z", "x", "y", "result")


def build_queue(spark, d):
    gated = R.gate(_requests(spark, d))
    built = R.build_queue(gated.where("event_id % 3 = 0"), spark.createDataFrame([], "key string"), CODEC, VERSION, DIGEST)
    return R.build_queue(gated, built, CODEC, VERSION, DIGEST)


def token_bucket_batch(spark, d):
    return R.token_bucket(_requests(spark, d), RATE, BURST)


def request_counters(spark, d):
    return R.counters(_answered(spark, d))


QUERIES = {f.__name__: f for f in (scan_request_log, gate_coarse, gate_bundle, gate_terrain, request_cost, representation_key, etag_v1_terrain, safe_version, expand_stages, resolve_requests, build_queue, token_bucket_batch, request_counters)}

INT = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') THEN try_cast({0} AS BIGINT) END"
GATED = f"""+ parsed AS (SELECT event_id, client, ms, kind, extra, refused, {INT.format('z')} AS z, {INT.format('x')} AS xi, {INT.format('y')} AS yi FROM requests),
judged AS (SELECT *, CASE WHEN refused IS NOT NULL THEN refused
  WHEN kind IN ('coarse', 'terrain') THEN CASE WHEN z IS NULL THEN 'bad_zoom' WHEN z < 0 OR z > 10 THEN 'blocked' WHEN xi IS NULL OR yi IS NULL THEN 'bad_tile'
    WHEN xi < 0 OR yi < 0 OR xi >= (1 << z) OR yi >= (1 << z) THEN 'range' WHEN kind = 'terrain' AND z > 12 THEN 'deep' ELSE 'pass' END
  WHEN kind = 'terrain_bundle' THEN CASE WHEN z IS NULL OR xi IS NULL OR yi IS NULL THEN 'bad_path' WHEN NOT (z IN (11, 12) AND xi BETWEEN 0 AND 1023 AND yi BETWEEN 0 AND 1023) THEN 'range' ELSE 'pass' END
  ELSE CASE WHEN extra THEN 'extra' WHEN z IS NULL OR xi IS NULL OR yi IS NULL THEN 'bad_path' WHEN NOT (z BETWEEN 11 AND 14 AND xi BETWEEN 0 AND 1023 AND yi BETWEEN 0 AND 1023) THEN 'invalid' ELSE 'pass' END
  END AS outcome FROM parsed),
gated AS (SELECT event_id, client, ms, kind, z, outcome, CASE WHEN outcome IN ('blocked', 'range', 'deep', 'unrouted') THEN 404 WHEN outcome = 'bad_method' THEN 405 WHEN outcome = 'preflight' THEN 204 WHEN outcome = 'service' THEN 200 WHEN outcome <> 'pass' THEN 400 END AS status,
  CASE WHEN outcome = 'pass' THEN xi END AS x, CASE WHEN outcome = 'pass' THEN yi END AS y FROM judged) """  # fmt: skip


def gated(sql: str) -> str:
    return with_tables(REQUESTS, GATED + sql)


# Only what passes the gate pays, at its real cost; then a raw tile is there or not, and a bundle is built once.
ANSWERED = GATED.rstrip() + """, paying AS (SELECT *, (CASE WHEN kind IN ('coarse', 'terrain') THEN 1 ELSE 1 << (z - 10) END)::BIGINT * 1000000 AS need, row_number() OVER (PARTITION BY client ORDER BY ms, event_id) AS k FROM gated WHERE outcome = 'pass'),
f(client, event_id, k, last, tokens, allowed) AS (
  SELECT client, event_id, k, ms, 16000000::BIGINT - need, true FROM paying WHERE k = 1
  UNION ALL SELECT client, event_id, k, last, CASE WHEN t >= need THEN t - need ELSE t END, t >= need FROM (
    SELECT r.client, r.event_id, r.k, greatest(f.last, r.ms) AS last, need, least(16000000, f.tokens + greatest(0, r.ms - f.last) * 125) AS t FROM f JOIN paying r ON r.client = f.client AND r.k = f.k + 1)),
answered AS (SELECT event_id, kind, x, y, outcome, CASE outcome WHEN 'limited' THEN 429 WHEN 'empty' THEN 204 WHEN 'ok' THEN 200 WHEN 'cached' THEN 200 ELSE status END AS status FROM (
  SELECT g.event_id, kind, z, x, y, status, CASE WHEN outcome <> 'pass' THEN outcome WHEN NOT allowed THEN 'limited'
    WHEN kind IN ('coarse', 'terrain') AND NOT (z = 8 AND (x, y) IN (SELECT (x % 256, y % 256) FROM tiles WHERE octet_length(encode(payload)) > 0)) THEN 'empty'
    WHEN kind IN ('bundle1', 'bundle2', 'bundle3') AND row_number() OVER (PARTITION BY kind, z, x, y, allowed ORDER BY ms, g.event_id) > 1 THEN 'cached' ELSE 'ok' END AS outcome
  FROM gated g LEFT JOIN f ON f.event_id = g.event_id)) """


def answered(sql: str) -> str:
    return with_tables(REQUESTS + " " + TILES, ANSWERED + sql, recursive=True)


KEY = "'spark-scb1gz-r1:2026%2001%2Fa%2Ab~$&+:=@:d0:10:' || x || ':' || y || ':'"
STAGES = "(VALUES (13, 0), (14, 1), (14, 2)) s(sz, part)"
QUEUE = f"""SELECT DISTINCT {KEY} || stage_zoom || ':' || part || ':stage' AS key, x AS x10, y AS y10, stage_zoom, part FROM (
  SELECT event_id, x, y, z::INTEGER AS stage_zoom, 0 AS part FROM gated WHERE kind = 'bundle3' AND outcome = 'pass' AND z < 14
  UNION ALL SELECT event_id, x, y, sz, s.part FROM gated, {STAGES} WHERE kind = 'bundle3' AND outcome = 'pass' AND z = 14)"""
SQL = {
    "scan_request_log": with_tables(REQUESTS, "SELECT event_id, ms, client, kind, CASE WHEN kind <> 'service' THEN z END AS z, CASE WHEN kind <> 'service' THEN x END AS x, CASE WHEN kind <> 'service' THEN y END AS y, extra, refused FROM requests"),
    "gate_coarse": answered("SELECT event_id, outcome, status, x, y FROM answered WHERE kind = 'coarse'"),
    "gate_bundle": answered("SELECT event_id, outcome, status, x, y FROM answered WHERE kind IN ('bundle1', 'bundle2', 'bundle3')"),
    "gate_terrain": answered("SELECT event_id, outcome, status, x, y FROM answered WHERE kind IN ('terrain', 'terrain_bundle')"),
    "request_cost": gated("SELECT event_id, CASE WHEN kind IN ('coarse', 'terrain') THEN 1 ELSE 1 << (z - 10) END::BIGINT AS tokens FROM gated WHERE outcome = 'pass'"),
    "representation_key": gated(f"SELECT event_id, {KEY} || z AS key FROM gated WHERE outcome = 'pass' AND kind = 'bundle3'"),
    "etag_v1_terrain": gated("""SELECT event_id, CASE kind WHEN 'bundle2' THEN '"v1:10:' ELSE '"terrain:v1:10:' END || x || ':' || y || ':' || z || '"' AS etag, CASE WHEN event_id % 2 = 0 THEN 304 ELSE 200 END AS status
        FROM gated WHERE outcome = 'pass' AND kind IN ('bundle2', 'terrain_bundle')"""),
    "safe_version": with_tables("releases", "SELECT seq, regexp_replace(version, '[^A-Za-z0-9._-]', '-', 'g') AS safe FROM releases"),
    "expand_stages": gated("""SELECT event_id, 0 AS stage_ord, CASE WHEN z = 14 THEN 13 ELSE z END::INTEGER AS stage_zoom, 0 AS part FROM gated WHERE outcome = 'pass' AND kind IN ('bundle2', 'bundle3')
        UNION ALL SELECT event_id, 1, 14, CASE kind WHEN 'bundle3' THEN 1 ELSE 0 END FROM gated WHERE outcome = 'pass' AND kind IN ('bundle2', 'bundle3') AND z = 14
        UNION ALL SELECT event_id, 2, 14, 2 FROM gated WHERE outcome = 'pass' AND kind = 'bundle3' AND z = 14"""),
    "resolve_requests": with_tables(REQUESTS + " " + TILES, GATED + """SELECT event_id, z, x, y, CASE WHEN z = 8 AND (x, y) IN (SELECT (x % 256, y % 256) FROM tiles WHERE octet_length(encode(payload)) > 0) THEN 'ok' ELSE 'empty' END AS result
        FROM gated WHERE outcome = 'pass' AND kind IN ('coarse', 'terrain')"""),
    "build_queue": gated(f"SELECT * FROM ({QUEUE}) WHERE key NOT IN (SELECT key FROM ({QUEUE.replace('FROM gated', 'FROM (SELECT * FROM gated WHERE event_id % 3 = 0) g')}))"),
    "token_bucket_batch": with_tables(REQUESTS, """+ r AS (SELECT client, event_id, ms, cost * 1000000 AS need, row_number() OVER (PARTITION BY client ORDER BY ms, event_id) AS k FROM requests),
        f(client, event_id, k, last, tokens, allowed) AS (
          SELECT client, event_id, k, ms, 16000000::BIGINT - need, true FROM r WHERE k = 1
          UNION ALL SELECT client, event_id, k, last, CASE WHEN t >= need THEN t - need ELSE t END, t >= need FROM (
            SELECT r.client, r.event_id, r.k, greatest(f.last, r.ms) AS last, need, least(16000000, f.tokens + greatest(0, r.ms - f.last) * 125) AS t FROM f JOIN r ON r.client = f.client AND r.k = f.k + 1))
        SELECT client, event_id, allowed FROM f""", recursive=True),
    "request_counters": answered("""SELECT metric, count(*) AS value FROM (SELECT unnest(CASE WHEN kind IN ('coarse', 'terrain') AND outcome IN ('blocked', 'empty', 'ok') THEN ['mapapi_' || kind || '_' || outcome || '_total']
        WHEN kind = 'terrain_bundle' AND outcome = 'ok' THEN ['mapapi_terrain_bundle_ok_total']
        WHEN kind IN ('bundle1', 'bundle2', 'bundle3') AND outcome IN ('ok', 'cached') THEN list_concat(CASE kind WHEN 'bundle3' THEN ['mapapi_bundle_v3_total'] ELSE [] END, [CASE outcome WHEN 'ok' THEN 'mapapi_bundle_ok_total' ELSE 'mapapi_bundle_cache_hit_total' END])
        ELSE [] END) AS metric FROM answered) GROUP BY metric"""),
}
