"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tilewright.llm.common import join_spread, materialise, min_label
from tilewright.llm.hashing import mix64
from tilewright.llm.vectors import local_components, matrix, rotate, valid

# A bucket of more rows is dealt out as pairs of blocks of this size.
BLOCK = 2_048
CHUNK = 200_000


def codes(x: np.ndarray, tables: int, polytopes: int, probes: int) -> np.ndarray:
    """Bucket codes (rows, tables, 1 + probes): the code itself first, then the nearest other ones.

    A table joins the nearest signed axes of `polytopes` rotations; a probe takes a second or third
    nearest axis where that costs least.
    """
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    choices = min(3, 1 << max(0, int(x.shape[1] - 1).bit_length()))
    ways = np.array(list(itertools.product(range(choices), repeat=polytopes)))
    for t in range(tables):
        axis, loss = [], []
        for k in range(polytopes):
            y = rotate(x, seed=t * 64 + k)
            best = np.argsort(-np.abs(y), axis=1)[:, :choices]
            top = np.take_along_axis(y, best, 1)
            axis.append(best * 2 + (top < 0))
            loss.append((np.abs(top[:, :1]) - np.abs(top)) ** 2)
        total = sum(loss[k][:, ways[:, k]] for k in range(polytopes))
        pick = np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]
        code = np.zeros(pick.shape, np.int64)
        for k in range(polytopes):
            code = code * (2 * y.shape[1]) + np.take_along_axis(axis[k], ways[:, k][pick], 1)
        out[:, t, : pick.shape[1]] = code
        out[:, t, pick.shape[1] :] = code[:, :1]
    return out


def first_meeting(ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, code) of the bucket that counts each pair: the first where one has its own code and the other probes."""
    pa_, pb_ = ca[:, :, 0], cb[:, :, 0]
    in_a, in_b = (ca == pb_[:, :, None]).any(2), (cb == pa_[:, :, None]).any(2)
    t = np.argmax(in_a | in_b, axis=1)
    r = np.arange(len(t))
    big = np.iinfo(np.int32).max
    return t, np.minimum(np.where(in_a[r, t], pb_[r, t], big), np.where(in_b[r, t], pa_[r, t], big))


def link(vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, probes: int = 2, polytopes: int | None = None, block: int = BLOCK) -> DataFrame:
    """For each vector: vec_id, n_links, component_id, kept.

    vectors has vec_id, label and embedding; other columns are ignored. Vectors are compared when their
    labels are equal and not null and they have as many components. Rows of a null vec_id, null label or
    an invalid vector link with nothing; their component is their own vec_id. Equal vectors of a label
    form a class; classes meet in buckets, cosines are verified in double precision, and a pair is
    counted in the first bucket where it meets. A bucket's task returns counts and a spanning forest of
    its links, never its pairs. Rows of the same vec_id are vectors of their own, linked to one another only
    if their vectors are. tables and polytopes are set by the size of the largest label unless given.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid("embedding")
    rows = rows.withColumn("_ok", usable)
    classes = rows.where("_ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    dim = 1 << max(1, ((classes.agg(F.max(F.size("embedding"))).first()[0] or 2) - 1).bit_length())
    # more axes to a code as labels grow, so that buckets stay near 256 rows; more tables make up for it
    polytopes = polytopes or min(4, max(1, math.ceil(math.log(max(most, 2) / 256) / math.log(2 * dim))))
    tables = tables or (8, 14, 24, 40)[polytopes - 1]

    def post(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            size = np.asarray(pa.compute.list_value_length(batch.column("embedding")))
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                c = codes(matrix(part.column("embedding")), tables, polytopes, probes)
                # a salt for the number of components: vectors of other lengths meet in other buckets. Codes that
                # fall together in 32 bits only make one bucket of two.
                c = (mix64((c + int(d) * 1_000_003).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * c[0].size, pa.int32()), pa.array(c.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], [*part.schema.names, "codes"])

    placed = classes.select("cls", "n", "label", "embedding")
    coded = placed.mapInArrow(post, StructType([*placed.schema.fields, StructField("codes", ArrayType(IntegerType()))]))
    wide = 1 + probes
    posts = coded.select("*", F.posexplode("codes").alias("at", "code")).withColumn("table", (F.col("at") / wide).cast("int")).withColumn("own", F.col("at") % wide == 0)
    # few components have fewer codes than there are probes: a code of a table is posted once, the own one first
    posts = posts.where(F.array_position(F.slice("codes", F.col("table") * wide + 1, wide), F.col("code")) == F.col("at") % wide + 1).drop("at")
    keys = ["label", "table", "code"]
    large = posts.select(*keys).groupBy(keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    posts = posts.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    posts = posts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posts = posts.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")
    total = classes.count() * tables * wide
    groups = max(1, total // 16_384)
    posts = posts.withColumn("task", F.pmod(F.xxhash64(*keys, "lo", "hi"), F.lit(groups)).cast("int"))
    found = materialise(posts.groupBy("task").applyInArrow(lambda t: verify(t, threshold, tables, wide), "a long, b long, links long"), "links")
    counts = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    parts = min_label(found.where("links is null").select("a", "b")).withColumnRenamed("id", "cls")
    joined = materialise(classes.join(counts.hint("merge"), "cls", "left").join(parts.hint("merge"), "cls", "left"), "joined")
    least = materialise(joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("copies")), "least")
    total = rows.count()
    done = join_spread(joined, least, ["component"], total)
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    done = materialise(done.select("label", "embedding", links, F.coalesce("low", "rep").alias("component_id"), F.col("n").alias("copies")), "done")
    ok = join_spread(rows.where("_ok").drop("_ok"), done, ["label", "embedding"], total).select("vec_id", "n_links", "component_id")
    rest = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def verify(t: pa.Table, threshold: float, tables: int, wide: int) -> pa.Table:
    """Counts and spanning edges of the links of a task's buckets."""
    label = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
    table, code = t["table"].to_numpy(), t["code"].to_numpy()
    lo, hi, block, own, rep, n = (t[c].to_numpy() for c in ("lo", "hi", "block", "own", "cls", "n"))
    vec, code_all = t["embedding"].combine_chunks(), matrix_int(t["codes"]).reshape(len(t), tables, wide)
    order = np.lexsort((block, hi, lo, code, table, label))
    keys = np.stack([label, table, code, lo, hi])[:, order]
    cut = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if len(order) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(order)]
    out_a, out_b, links = [], [], {}
    for x, y in zip(cut, ends, strict=True):
        idx = order[x:y]
        if len(idx) < 2 or not own[idx].any():
            continue
        i0, i1 = idx[block[idx] == lo[idx[0]]], idx[block[idx] == hi[idx[0]]]
        if lo[idx[0]] == hi[idx[0]]:
            i1 = i0
        if not len(i0) or not len(i1):
            continue
        v0 = unit(matrix(vec.take(pa.array(i0))))
        if i1 is i0:
            v1 = v0
        else:
            v1 = unit(matrix(vec.take(pa.array(i1))))
        sa, sb = [], []
        step = max(1, CHUNK // len(i1))
        for r in range(0, len(i0), step):
            near = v0[r : r + step] @ v1.T >= threshold
            near &= own[i0[r : r + step]][:, None] | own[i1][None, :]
            p, q = np.nonzero(near)
            p, q = i0[p + r], i1[q]
            keep = rep[p] < rep[q] if i1 is i0 else rep[p] != rep[q]
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            ft, fc = first_meeting(code_all[p], code_all[q])
            mine = (ft == table[idx[0]]) & (fc == code[idx[0]])
            sa.append(p[mine])
            sb.append(q[mine])
        if not sa:
            continue
        p, q = np.concatenate(sa), np.concatenate(sb)
        for u, v in ((p, q), (q, p)):
            who, inverse = np.unique(rep[u], return_inverse=True)
            for w, c in zip(who.tolist(), np.bincount(inverse, weights=n[v]).astype(np.int64).tolist(), strict=True):
                links[w] = links.get(w, 0) + c
        who, inverse = np.unique(np.concatenate([rep[p], rep[q]]), return_inverse=True)
        root = local_components(len(who), inverse[: len(p)], inverse[len(p) :])
        hung = np.flatnonzero(root != np.arange(len(who)))
        out_a.append(who[hung])
        out_b.append(who[root[hung]])
    a = np.concatenate([*out_a, np.array(list(links), np.int64)]) if links else np.zeros(0, np.int64)
    edges = sum(map(len, out_a))
    b = pa.array(np.concatenate([*out_b, np.zeros(len(links), np.int64)]) if links else np.zeros(0, np.int64), pa.int64())
    counts = pa.array([None] * edges + list(links.values()), pa.int64())
    return pa.table({"a": pa.array(a, pa.int64()), "b": b, "links": counts})


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix_int(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy()


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.93 within a label."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
