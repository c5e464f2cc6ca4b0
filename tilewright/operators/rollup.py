"""Sums over every ancestor of tiles, from one sort by Hilbert id: the id of a parent is a shift of its children's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import addressing as A
from tilewright.sources import archive
from tilewright.sources.archive_source import coordinates
from tilewright.sources.scratch import commit

DEEPEST = 31
PARTS = "z int, node long, total long, seam boolean"


def _prefix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each zoom, the sums of consecutive rows under one node. The first and the last node of a zoom may go on in other tasks: seams."""
    open_nodes: dict[int, list] = {}  # zoom: node, total, whether it is the first
    for b in batches:
        z, key, n = (b.column(c).to_numpy() for c in ("z", "key", "n"))
        out = []
        for k in range(int(z.max(initial=-1)) + 1):
            mine = z >= k
            node = key[mine] >> np.int64(2 * (DEEPEST - k))
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            total, node = np.add.reduceat(n[mine], start), node[start]
            seam = np.zeros(len(node), bool)
            if k not in open_nodes:
                seam[0] = True
            elif open_nodes[k][0] == node[0]:
                total[0] += open_nodes[k][1]
                seam[0] = open_nodes[k][2]
            else:
                node, total, seam = (np.concatenate([[v], a]) for v, a in zip(open_nodes[k], (node, total, seam), strict=True))
            open_nodes[k] = [int(node[-1]), int(total[-1]), bool(seam[-1])]
            if len(node) > 1:
                out.append((np.full(len(node) - 1, k), node[:-1], total[:-1], seam[:-1]))
        if out:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int64, np.int64, bool), strict=True)], names=["z", "node", "total", "seam"])
    if open_nodes:
        yield pa.RecordBatch.from_pylist([{"z": k, "node": v[0], "total": v[1], "seam": True} for k, v in open_nodes.items()], pa.schema([("z", pa.int32()), ("node", pa.int64()), ("total", pa.int64()), ("seam", pa.bool_())]))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bases = np.array([archive.base(k) for k in range(DEEPEST + 1)], np.int64)
    for b in batches:
        z = b.column("z").to_numpy()
        _, x, y = coordinates(bases[z] + b.column("node").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("z"), pa.array(x), pa.array(y), b.column("total")], names=["z", "x", "y", "total"])


def rollup(tiles: DataFrame, measure: str = "n") -> DataFrame:
    """(z, x, y, total): the sum of a measure of tiles (z, x, y, of any zooms) under each of them and of its ancestors up to zoom 0.

    The rows are shuffled once, by range of their ids; equal tiles may span tasks. Sums of all zooms come out of one pass
    over each task's rows, and only the nodes at its two ends meet again.
    """
    z = F.col("z").cast("int")
    key = F.expr(f"shiftleft(_d, 2 * ({DEEPEST} - z))")
    # rows by way of inline: the optimizer would put the expressions of x and y, and those of the id, into every place that names them
    plain = tiles.select(F.inline(F.array(F.struct(z.alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(measure).cast("long").alias("n")))))
    rows = plain.select(F.inline(F.array(F.struct("z", (A.hilbert_id(F.col("z"), F.col("x"), F.col("y")) - A.level_base(F.col("z"))).alias("_d"), "n"))))
    rows = rows.where("_d is not null").select("z", key.alias("key"), "n", F.monotonically_increasing_id().alias("_salt"))
    parts = rows.repartitionByRange("key", "_salt").sortWithinPartitions("key").select("z", "key", "n").mapInArrow(_prefix_sums, PARTS)
    parts = commit(parts, "rollup")
    seams = parts.where("seam").groupBy("z", "node").agg(F.sum("total").alias("total"))
    return parts.where("not seam").select("z", "node", "total").unionByName(seams).mapInArrow(_places, "z int, x long, y long, total long")
