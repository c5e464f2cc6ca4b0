"""Input tables of the map-tile queries, derived alike in Spark and in DuckDB from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import addressing as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", (8 + e % 8).cast("int").alias("z"), (-180 + (e * 7919 % 3600000) / 10000).alias("lon"), (-85 + (e * 104729 % 1700000) / 10000).alias("lat"))


def tiled_points(spark, d) -> DataFrame:
    p = points(spark, d)
    x, y = A.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z"))
    return p.withColumn("x", x).withColumn("y", y)


def tiles(spark, d, payload: str = "text") -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col(payload).alias("t"))
    s = F.col("s")
    first = F.when(s < 4, 0).when(s < 20, 4).when(s < 84, 20).otherwise(84)
    out = docs.withColumn("s", F.col("doc_id") % 340).withColumn("z", F.when(s < 4, 11).when(s < 20, 12).when(s < 84, 13).otherwise(14))
    out = out.withColumn("slot", s - first).withColumn("side", A.bundle_side(F.col("z")))
    x10 = 164 + F.floor(F.col("doc_id") / 340)
    return out.select(
        "doc_id", "z", (x10 * F.col("side") + F.col("slot") % F.col("side")).cast("long").alias("x"), (357 * F.col("side") + F.floor(F.col("slot") / F.col("side"))).cast("long").alias("y"),
        F.when(F.col("doc_id") % 5 != 0, F.encode("t", "UTF-8")).alias("payload"), F.lit(False).alias("gzipped"),
    )


def map_tiles(spark, d, payload: str = "text") -> DataFrame:
    """The same tiles by their place on the map: over 1,024 - 164 anchors (292,400 documents) reach past the date line, into the next world."""
    z, x = F.col("z"), F.col("x")
    return tiles(spark, d, payload).select("doc_id", "z", A.world(x, z).alias("world"), A.on_map(x, z).alias("x"), "y", "payload", "gzipped")


def pixels(spark, d) -> DataFrame:
    """Pixels of zoom 12 in tiles of 8 x 8, filled one after another in squares of 64 x 64 tiles: room for 10^9 events."""
    e = F.col("event_id")
    t, p = F.floor(e / 64), e % 64
    x, y = t % 64 + 64 * (F.floor(t / 4096) % 64), F.floor(t / 64) % 64 + 64 * F.floor(t / 262144)
    return table(spark, d, "events").select(F.lit(12).alias("z"), (x * 8 + p % 8).alias("gx"), (y * 8 + F.floor(p / 8)).alias("gy"), F.rint(F.col("value") * 10 - 500).cast("int").alias("metres"))


def samples(spark, d) -> DataFrame:
    """Samples of heights, 64 to a degree, filling cell after cell in two columns of 160: room for 2 * 10^8 events."""
    e = F.col("event_id")
    c, p = F.floor(e / 4096), e % 4096
    lat = (F.floor(c / 2) + 78) % 160 - 80 + F.floor(p / 64) / 64.0
    lon = c % 2 + 2 * F.floor(c / 320) - 180 + p % 64 / 64.0
    metres = F.when(e % 50 == 0, -32767.0).otherwise(F.rint(F.col("value") * 10 - 100))
    return table(spark, d, "events").select(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.lit(1 / 64).alias("step"), metres.alias("metres"))


def request_log(spark, d) -> DataFrame:
    """Requests as they arrive, with the cost that the bare bucket takes: raw tiles and bundles, some with bad zooms, queries, bodies or methods."""
    e, kind = F.col("event_id"), F.col("event_type")
    p = tiled_points(spark, d).select(F.col("event_id").alias("pid"), F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = table(spark, d, "events").join(p, F.col("event_id") == F.col("pid"))
    deep = F.col("pz").isin(11, 12, 13, 14) & kind.isin("click", "signup", "error")
    ax, ay = A.anchor(F.col("pz"), F.col("px"), F.col("py"))
    z, x, y = F.when(e % 97 == 0, "bad").when(e % 7 == 0, F.concat(F.lit("%2B"), F.col("pz"))).otherwise(F.col("pz").cast("string")), F.when(deep, ax).otherwise(F.col("px")), F.when(deep, ay).otherwise(F.col("py"))
    stem = F.when(kind == "view", "/planet").when(kind == "click", "/planet/bundle/v3").when((kind == "signup") & (e % 3 == 0), "/planet/bundle/v1").when(kind == "signup", "/planet/bundle/v2").when(kind == "purchase", "/terrain").otherwise("/terrain/bundle/v1")
    raw = kind.isin("view", "purchase")
    path = F.when(e % 211 == 0, "/planet/tiles.json").when(e % 223 == 0, "/livez").when(raw, F.concat_ws("/", stem, z, x, y)).otherwise(F.concat_ws("/", stem, x, y, z))
    query = F.when(e % 178 == 0, "?").when(e % 89 == 0, "?v=1").otherwise("")
    method = F.when(e % 131 == 0, "POST").when(e % 61 == 0, "OPTIONS").when(e % 10 == 0, "HEAD").otherwise("GET")
    host = F.concat_ws(".", F.lit("10.0"), F.floor(F.col("user_id") / 256), F.col("user_id") % 256)
    peer = F.when(F.col("user_id") % 9 == 0, F.concat(F.lit("[fd00::"), F.col("user_id"), F.lit("]:"), 1024 + e % 50000)).when(F.col("user_id") % 31 == 0, host).otherwise(F.concat(host, F.lit(":"), 1024 + e % 50000))
    return out.select(
        "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"), peer.alias("peer"), method.alias("method"), F.concat(path, query).alias("target"),
        F.when(e % 83 == 0, 5).when(e % 101 == 0, -1).otherwise(0).cast("long").alias("body_length"), F.pow(F.lit(2.0), e % 5).cast("long").alias("cost"),
    )


def layers(spark, d) -> DataFrame:
    t = tiles(spark, d).select("doc_id", "z", "x", "y")
    n = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "n_chars")
    kinds = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("layer"), F.lit(m).alias("m")) for k, (name, m) in enumerate([("building", 211), ("poi", 97), ("housenumber", 53), ("transportation", 31)])])
    out = t.join(n, F.col("doc_id") == F.col("i")).withColumn("l", F.explode(kinds))
    return out.select("z", "x", "y", "l.ord", "l.layer", (F.col("n_chars") % F.col("l.m")).alias("bytes"))


def landcover(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    z = (4 + F.col("doc_id") % 4).cast("int")
    cls = F.when((F.col("doc_id") % 4 == 0) & (F.col("lang") == "en"), None).otherwise(F.col("lang"))
    return docs.select(z.alias("z"), (F.col("doc_id") % 3).alias("x"), (F.floor(F.col("doc_id") / 4) % 2).alias("y"), cls.alias("class"), (5 + F.col("doc_id") % 8).cast("int").alias("minzoom"), (F.col("doc_id") % 16).cast("int").alias("pixels"), "doc_id",
        (4 + F.col("doc_id") % 11).cast("int").alias("deep"), F.when(F.col("doc_id") % 5 == 0, "glaciers").otherwise("osm").alias("source"), (F.col("doc_id") * 37 % 600).alias("points"),
        F.when(F.col("lang") == "en", "wood").when(F.col("lang") == "de", "forest").when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("subclass"),
    )


def dem_listing(spark, d) -> DataFrame:
    lat, lon = F.col("event_id") % 180 - 90, F.floor(F.col("event_id") / 180) * 7 % 360 - 180
    two = lambda v, neg, pos, w: F.concat(F.when(v < 0, neg).otherwise(pos), F.lpad(F.abs(v).cast("string"), w, "0"))
    e = table(spark, d, "events")
    name = lambda r: F.concat(F.lit(f"  Copernicus_DSM_COG_{r // 3}_"), two(lat, "S", "N", 2), F.lit("_00_"), two(lon, "W", "E", 3), F.lit("_00_DEM "))
    coarse = e.select(name(90).alias("name"), F.lit(90).alias("resolution"))
    return coarse.unionByName(e.where("event_id % 3 <> 0").select(name(30).alias("name"), F.lit(30).alias("resolution")))


def ledger(spark, d) -> DataFrame:
    e = table(spark, d, "events").where("event_id % 2 = 0")
    unit = F.concat(F.lit("z12:"), (F.col("event_id") % 180 - 90).cast("string"), F.lit(","), (F.floor(F.col("event_id") / 180) * 7 % 360 - 180).cast("string"))
    return e.select(unit.alias("unit"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("done_at"))


def manifests(spark, d) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 11
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    i = e.cast("string")
    raw = F.concat(
        F.lit('{"schema_version":'), F.when(k == 1, "2").otherwise("1"), F.lit(',"version":'), q(F.when(k == 2, "").otherwise(F.concat(F.lit("v"), i))),
        F.lit(',"url":'), q(F.when(k == 3, F.concat(F.lit("http://host/"), i)).when(e % 2 == 0, F.concat(F.lit("local:"), i)).otherwise(F.concat(F.lit("https://host/"), i))),
        F.lit(',"sha256":'), q(F.when(k == 4, "abc").otherwise(F.sha2(i, 256))), F.lit(',"size":'), F.when(k == 5, "0").otherwise((e + 1).cast("string")),
        F.lit(',"min_zoom":0,"max_zoom":'), F.when(k == 6, "25").otherwise((8 + e % 8).cast("string")), F.lit(',"tile_schema":'), q(F.when(k == 7, "").otherwise("openmaptiles")),
        F.lit(',"created_at":'), q(F.when(k == 8, "yesterday").otherwise("2026-01-02T03:04:05Z")), F.when(k == 9, ',"extra":1').otherwise(""), F.when(k == 10, "").otherwise("}"),
    )
    return table(spark, d, "events").select(e.alias("id"), raw.alias("raw"))


def releases(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    first = e.groupBy("event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    out = e.join(first, "event_type")
    return out.select(F.col("event_type").alias("dataset"), F.concat(F.lit("v/"), F.col("event_id").cast("string"), F.lit(" ä")).alias("version"), F.col("ts").cast("timestamp").alias("mtime"), (F.col("event_id") == F.col("f.event_id")).alias("active"), F.col("event_id").alias("seq"))


# The same tables in DuckDB, as named parts of a WITH clause.
CTE = {
    "points": "SELECT event_id, (8 + event_id % 8)::INTEGER AS z, -180 + ((event_id * 7919) % 3600000) / 10000 AS lon, -85 + ((event_id * 104729) % 1700000) / 10000 AS lat FROM events",
    "tiled": """SELECT *, trunc((lon + 180.0) / 360.0 * pow(2.0, z))::BIGINT AS x,
        trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * pow(2.0, z))::BIGINT AS y FROM points""",
    "placed": "SELECT *, doc_id % 340 AS s, CASE WHEN doc_id % 340 < 4 THEN 11 WHEN doc_id % 340 < 20 THEN 12 WHEN doc_id % 340 < 84 THEN 13 ELSE 14 END AS z FROM documents",
    "slotted": "SELECT *, (1 << (z - 10))::BIGINT AS side, s - CASE WHEN s < 4 THEN 0 WHEN s < 20 THEN 4 WHEN s < 84 THEN 20 ELSE 84 END AS slot FROM placed",
    "tiles": """SELECT doc_id, z, ((164 + doc_id // 340) * side + slot % side)::BIGINT AS x, (357 * side + slot // side)::BIGINT AS y,
        CASE WHEN doc_id % 5 <> 0 THEN text END AS payload, lang, n_chars, slot::BIGINT AS slot, 164 + doc_id // 340 AS x10 FROM slotted""",
    "pixels": """SELECT 12 AS z, (t % 64 + 64 * (t // 4096 % 64)) * 8 + p % 8 AS gx, (t // 64 % 64 + 64 * (t // 262144)) * 8 + p // 8 AS gy, max(round_even(value * 10 - 500, 0)::INTEGER) AS metres
        FROM (SELECT *, event_id // 64 AS t, event_id % 64 AS p FROM events) GROUP BY ALL""",
    "samples": """SELECT (c // 2 + 78) % 160 - 80 + (p // 64) / 64.0::DOUBLE AS lat, c % 2 + 2 * (c // 320) - 180 + (p % 64) / 64.0::DOUBLE AS lon, max(metres) AS metres
        FROM (SELECT event_id // 4096 AS c, event_id % 4096 AS p, CASE WHEN event_id % 50 = 0 THEN -32767.0 ELSE round_even(value * 10 - 100, 0) END::DOUBLE AS metres FROM events) GROUP BY ALL""",
    "arrived": """SELECT event_id, ms, CASE WHEN user_id % 9 = 0 THEN '[fd00::' || user_id || ']:' || port WHEN user_id % 31 = 0 THEN host ELSE host || ':' || port END AS peer,
        CASE WHEN event_id % 131 = 0 THEN 'POST' WHEN event_id % 61 = 0 THEN 'OPTIONS' WHEN event_id % 10 = 0 THEN 'HEAD' ELSE 'GET' END AS method,
        CASE WHEN event_id % 211 = 0 THEN '/planet/tiles.json' WHEN event_id % 223 = 0 THEN '/livez' WHEN event_type IN ('view', 'purchase') THEN stem || '/' || z || '/' || x || '/' || y ELSE stem || '/' || x || '/' || y || '/' || z END
          || CASE WHEN event_id % 178 = 0 THEN '?' WHEN event_id % 89 = 0 THEN '?v=1' ELSE '' END AS target,
        CASE WHEN event_id % 83 = 0 THEN 5 WHEN event_id % 101 = 0 THEN -1 ELSE 0 END::BIGINT AS body_length, pow(2, event_id % 5)::BIGINT AS cost
        FROM (SELECT e.event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, '10.0.' || user_id // 256 || '.' || user_id % 256 AS host, 1024 + e.event_id % 50000 AS port,
          CASE event_type WHEN 'view' THEN '/planet' WHEN 'click' THEN '/planet/bundle/v3' WHEN 'signup' THEN CASE WHEN e.event_id % 3 = 0 THEN '/planet/bundle/v1' ELSE '/planet/bundle/v2' END WHEN 'purchase' THEN '/terrain' ELSE '/terrain/bundle/v1' END AS stem,
          CASE WHEN e.event_id % 97 = 0 THEN 'bad' WHEN e.event_id % 7 = 0 THEN '%2B' || z ELSE z::VARCHAR END AS z,
          CASE WHEN z BETWEEN 11 AND 14 AND event_type IN ('click', 'signup', 'error') THEN x >> (z - 10) ELSE x END AS x,
          CASE WHEN z BETWEEN 11 AND 14 AND event_type IN ('click', 'signup', 'error') THEN y >> (z - 10) ELSE y END AS y FROM events e JOIN tiled t ON e.event_id = t.event_id)""",
    "routed": """SELECT *, split_part(target, '?', 1) AS path, contains(target, '?') OR body_length <> 0 AS extra,
        CASE WHEN regexp_full_match(peer, '[^:]*:[0-9]+') THEN split_part(peer, ':', 1) WHEN peer LIKE '[%' THEN regexp_extract(peer, '^.(.*).:[0-9]+$', 1) ELSE peer END AS client,
        str_split(split_part(target, '?', 1), '/') AS s FROM arrived""",
    "kinds": """SELECT *, CASE WHEN path IN ('/livez', '/readyz', '/metrics') THEN 'service' WHEN len(s) = 7 AND s[2] = 'planet' AND s[3] = 'bundle' AND s[4] IN ('v1', 'v2', 'v3') THEN 'bundle' || substr(s[4], 2)
          WHEN len(s) = 7 AND s[2] = 'terrain' AND s[3] = 'bundle' AND s[4] = 'v1' THEN 'terrain_bundle' WHEN len(s) = 5 AND s[2] = 'terrain' THEN 'terrain' WHEN len(s) = 5 AND s[2] = 'planet' THEN 'coarse' END AS kind FROM routed""",
    "requests": """SELECT event_id, client, ms, kind, cost, extra, url_decode(CASE WHEN len(s) = 7 THEN s[7] ELSE s[3] END) AS z, CASE WHEN len(s) = 7 THEN s[5] ELSE s[4] END AS x, CASE WHEN len(s) = 7 THEN s[6] ELSE s[5] END AS y,
        CASE WHEN kind IS NULL THEN 'unrouted' WHEN kind = 'service' THEN CASE WHEN method IN ('GET', 'HEAD') THEN 'service' ELSE 'bad_method' END WHEN method = 'OPTIONS' AND kind IN ('bundle2', 'bundle3') THEN 'preflight' WHEN method NOT IN ('GET', 'HEAD') THEN 'bad_method' END AS refused FROM kinds""",
    "layers": """SELECT z, x, y, l.ord, l.layer, n_chars % l.m AS bytes FROM tiles,
        (VALUES (0, 'building', 211), (1, 'poi', 97), (2, 'housenumber', 53), (3, 'transportation', 31)) l(ord, layer, m)""",
    "landcover": """SELECT (4 + doc_id % 4)::INTEGER AS z, doc_id % 3 AS x, (doc_id // 4) % 2 AS y, CASE WHEN doc_id % 4 = 0 AND lang = 'en' THEN NULL ELSE lang END AS class,
        (5 + doc_id % 8)::INTEGER AS minzoom, (doc_id % 16)::INTEGER AS pixels, doc_id,
        (4 + doc_id % 11)::INTEGER AS deep, CASE WHEN doc_id % 5 = 0 THEN 'glaciers' ELSE 'osm' END AS source, doc_id * 37 % 600 AS points, CASE lang WHEN 'en' THEN 'wood' WHEN 'de' THEN 'forest' ELSE CASE WHEN doc_id % 7 > 0 THEN lang END END AS subclass FROM documents""",
    "cells_all": """SELECT DISTINCT (event_id % 180 - 90)::INTEGER AS lat, ((event_id // 180) * 7 % 360 - 180)::INTEGER AS lon, event_id FROM events""",
    "dem_cells": """SELECT DISTINCT lat, lon, 90 AS resolution FROM cells_all UNION SELECT DISTINCT lat, lon, 30 FROM cells_all WHERE event_id % 3 <> 0""",
    "ledger": """SELECT 'z12:' || (event_id % 180 - 90) || ',' || ((event_id // 180) * 7 % 360 - 180) AS unit, event_id AS seq, ts AS done_at FROM events WHERE event_id % 2 = 0""",
    "releases": """SELECT event_type AS dataset, 'v/' || event_id || ' ä' AS version, ts AS mtime, event_id AS seq,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1 AS active FROM events""",
}


def with_tables(names: str, sql: str, recursive: bool = False) -> str:
    """sql behind a WITH clause of the named tables, in the order given."""
    parts = ", ".join(f"{n} AS ({CTE[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"


TILES = "placed slotted tiles"
POINTS = "points tiled"
REQUESTS = "points tiled arrived routed kinds requests"
