"""Approximate nearest neighbours: inverted lists, scanned in blocks of rotated columns with early abandoning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import materialise
from tilewright.llm.vectors import matrix, rotate, valid

# Rows the index is fitted on, lists at most, rows of a shard and queries of a task.
FIT_ROWS, MOST_LISTS, SHARD, QUERIES = 16_384, 512, 8_192, 4_096
COLUMNS, QUERY_ROWS = 16, 128
HELD = 32  # the lists that a query probes hold this many times k rows at least


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=k)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component that makes all norms `most`: the largest inner product is then the nearest row."""
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most * most - (x * x).sum(1)))[:, None]], axis=1)


def fit(sample: np.ndarray, rows: int, k: int, target: float = 0.99) -> tuple[np.ndarray, int, float]:
    """(centroids, lists to probe, largest norm) from a bounded sample.

    The number of probed lists is what finds `target` of the true neighbours of 256 sampled queries within
    the sample.
    """
    most = float(np.sqrt((sample * sample).sum(1).max())) if len(sample) else 1.0
    lists = int(max(1, min(MOST_LISTS, round(np.sqrt(rows) / 4), len(sample) // 32 or 1)))
    up = lifted(sample, most)
    centroids = kmeans(up, lists)
    of = np.argmin((centroids**2).sum(1)[None, :] - 2 * up @ centroids.T, axis=1)
    queries = sample[np.random.default_rng(2).choice(len(sample), min(256, len(sample)), replace=False)]
    near = np.argsort(-(queries @ sample.T), axis=1)[:, 1 : k + 1]
    ranked = np.argsort(np.argsort(distances(queries, centroids), axis=1), axis=1)
    need = np.take_along_axis(ranked, of[near], 1).ravel() if near.size else np.zeros(1, int)
    probe = int(np.quantile(need, target)) + 1
    return centroids, min(lists, probe), most


def distances(queries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of queries (their added component is 0) to lifted centroids, without the query's own norm."""
    return (centroids**2).sum(1)[None, :] - 2 * queries @ centroids[:, :-1].T


def scan_shard(base: pa.Table, queries: pa.Table, k: int, spread: float = 2.1) -> pa.Table:
    """The k best of a shard's rows in the probed lists of each query.

    Distances grow by blocks of rotated columns. The first block picks 4 * k rows whose exact distances
    bound the k-th best; after each block a candidate whose partial distance, scaled to all columns,
    exceeds that bound by more than the test allows (spread / sqrt(columns seen)) is abandoned. While
    many candidates are alive, a block is one matrix product; after that, only survivors are gathered.
    They are scored on the original vectors. The k rows that set the bound are never abandoned, so a shard
    gives k rows, or all its candidates.
    """
    out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(base) and len(queries):
        ids, x = base["vec_id"].to_numpy(), matrix(base["embedding"])
        lists, of = np.unique(base["list"].to_numpy(), return_inverse=True)
        most = float(np.sqrt((x * x).sum(1).max()))
        # the squared distance is |q|^2 + most^2 - 2 q.x in the lifted space, and a rotation keeps it
        rot = rotate(lifted(x, most), 7)
        d = rot.shape[1]
        norms = [(rot[:, c : c + COLUMNS] ** 2).sum(1) for c in range(0, d, COLUMNS)]
        qids, q = queries["query_id"].to_numpy(), matrix(queries["embedding"])
        probed = np.zeros((len(q), len(lists)), bool)
        for i, probes in enumerate(queries["lists"].to_pylist()):
            at = np.minimum(np.searchsorted(lists, probes), len(lists) - 1)
            probed[i, at[lists[at] == probes]] = True
        for r in range(0, len(q), QUERY_ROWS):
            qr, qi = q[r : r + QUERY_ROWS], qids[r : r + QUERY_ROWS]
            turned = rotate(np.concatenate([qr, np.zeros((len(qr), 1))], axis=1), 7)
            alive = probed[r : r + QUERY_ROWS][:, of] & (ids[None, :] != qi[:, None])
            part, limit, pairs = np.zeros(alive.shape), np.full(len(qr), np.inf), None
            sure = np.zeros(alive.shape, bool)
            for b, c in enumerate(range(0, d, COLUMNS)):
                xb, qb = rot[:, c : c + COLUMNS], turned[:, c : c + COLUMNS]
                seen = min(d, c + COLUMNS)
                if pairs is None:
                    part += norms[b][None, :] + (qb * qb).sum(1)[:, None] - 2 * qb @ xb.T
                    if b == 0 and alive.shape[1] > 4 * k:
                        near = np.argpartition(np.where(alive, part, np.inf), 4 * k, axis=1)[:, : 4 * k]
                        exact = np.einsum("qnd,qd->qn", x[near], qr)
                        exact[~np.take_along_axis(alive, near, 1)] = -np.inf
                        best = np.argpartition(exact, -k, axis=1)[:, -k:]
                        limit = (qr * qr).sum(1) + most * most - 2 * np.take_along_axis(exact, best, 1).min(1)
                        np.put_along_axis(sure, np.take_along_axis(near, best, 1), True, 1)
                        sure &= alive
                    bound = limit * (1 if seen >= d else (1 + spread / np.sqrt(seen)) ** 2 * seen / d) * (1 + 1e-9) + 1e-9
                    alive &= (part <= bound[:, None]) | sure
                    if np.count_nonzero(alive) < 0.05 * alive.size:
                        at, of_x = np.nonzero(alive)
                        pairs = at, of_x, part[at, of_x]
                else:
                    at, of_x, have = pairs
                    have = have + ((xb[of_x] - qb[at]) ** 2).sum(1)
                    bound = limit * (1 if seen >= d else (1 + spread / np.sqrt(seen)) ** 2 * seen / d) * (1 + 1e-9) + 1e-9
                    keep = (have <= bound[at]) | sure[at, of_x]
                    pairs = at[keep], of_x[keep], have[keep]
            at, of_x = pairs[:2] if pairs is not None else np.nonzero(alive)
            exact = np.concatenate([(x[of_x[i : i + 65_536]] * qr[at[i : i + 65_536]]).sum(1) for i in range(0, len(at), 65_536)] or [np.zeros(0)])
            by = np.lexsort((ids[of_x], -exact, at))
            at, of_x, exact = at[by], of_x[by], exact[by]
            first = np.searchsorted(at, np.arange(len(qr)))
            best = np.arange(len(at)) - first[at] < k
            out_q.append(qi[at[best]])
            out_v.append(ids[of_x[best]])
            out_s.append(exact[best])
    return pa.table({"query_id": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_v)), "score": pa.array(np.concatenate(out_s))})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (inner product in double).

    vectors and queries have vec_id and embedding; other columns are ignored. A query's own vec_id is no
    candidate. Null ids, and vectors that are null, zero, hold null or non-finite components or are not of
    the most common length, take no part. Ties go to the smaller vec_id; a query with fewer than k
    candidates gets them all: it goes down its ranked lists until they hold 32 * k rows that are not its own.
    Every row is indexed; centroids come from a bounded sample. Crowded lists are dealt out over many
    shards, and many queries of a shard over many tasks.
    """
    usable = F.col("vec_id").isNotNull() & valid("embedding")
    base = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    sizes = base.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    d, rows = sizes[0]["d"], sizes[0]["count"]
    base = base.where(F.size("embedding") == d)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.where(F.col("query_id").isNotNull() & valid("embedding") & (F.size("embedding") == d))
    sample = matrix(base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()["embedding"])
    centroids, probe, most = fit(sample, rows, k)
    own = base.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # rows of one vec_id, at most
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((centroids, probe, most))

    def place(batches):
        c, _, top = shared.value
        for b in batches:
            if len(b):
                up = lifted(matrix(b.column("embedding")), top)
                of = np.argmin((c * c).sum(1)[None, :] - 2 * up @ c.T, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(of.astype(np.int32))], ["vec_id", "embedding", "list"])

    placed = materialise(base.mapInArrow(place, "vec_id long, embedding array<double>, list int"), "lists")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    # lists are packed into shards of about SHARD rows; a larger list has shards of its own. (first shard, shards)
    shards, used, free = {}, 0, 0
    for c in range(len(centroids)):
        n = counts.get(c, 0)
        if n > SHARD:
            shards[c] = (used, -(-n // SHARD))
            used, free = used + shards[c][1], 0
        elif n:
            if n > free:
                used, free = used + 1, SHARD
            shards[c] = (used - 1, 1)
            free -= n
    # a literal map of the lists, which are MOST_LISTS at most
    of_shard = F.element_at(F.create_map(*[v for c, (s, m) in shards.items() for v in (F.lit(c), F.struct(F.lit(s).alias("first"), F.lit(m).alias("parts")))]), F.col("list"))
    dealt = placed.withColumn("_s", of_shard).withColumn("shard", (F.col("_s.first") + F.pmod(F.xxhash64("vec_id"), F.col("_s.parts"))).cast("int")).drop("_s")

    def probing(batches):
        c, n, _ = shared.value
        size = np.array([counts.get(p, 0) for p in range(len(c))])
        for b in (b.slice(i, 1_024) for b in batches for i in range(0, len(b), 1_024)):
            near = np.argsort(distances(matrix(b.column("embedding")), c), axis=1, kind="stable")
            enough = np.maximum(n, (np.cumsum(size[near], axis=1) < HELD * k + own).sum(1) + 1)
            take, shard, lists = [], [], []
            for i, probes in enumerate(near):
                mine = {}
                for p in probes[: enough[i]].tolist():
                    first, parts = shards.get(p, (0, 0))
                    for s in range(first, first + parts):
                        mine.setdefault(s, []).append(p)
                take += [i] * len(mine)
                shard += mine.keys()
                lists += mine.values()
            out = b.take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([out.column("query_id"), out.column("embedding"), pa.array(shard, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "embedding", "shard", "lists"])

    asks = asked.mapInArrow(probing, "query_id long, embedding array<double>, shard int, lists array<int>")
    # a shard comes once for each QUERIES queries that probe it, and not at all if none does
    wanted = materialise(asks.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slices")), "slices")
    asks = asks.join(wanted, "shard").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int")).drop("slices")
    dealt = dealt.join(wanted, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    found = dealt.groupBy("shard", "slice").cogroup(asks.groupBy("shard", "slice")).applyInArrow(lambda a, b: scan_shard(a, b, k), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every embedding whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
