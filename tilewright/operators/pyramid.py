"""Raster pyramids: means of two by two pixels from the finest zoom up, rounded at every level.

Tiles are blocks. A shuffle brings the blocks under a common ancestor some levels up to one task, which builds
all levels between, so it carries whole tiles and only every third level of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.blocks import BLOCKS, packed, table, unpacked, without_sea
from tilewright.sources.scratch import commit

AT_ONCE = 3  # levels of a step: a task holds 4^3 blocks at most


def level_up(blocks: DataFrame, size: int, levels: int = 1) -> DataFrame:
    """The parents of blocks, up to `levels` levels of them; all blocks are of one zoom.

    A parent pixel is the mean of its four children, rounded half to even; an absent tile counts 0. Tiles without a pixel
    above the sea are left out, and count 0 in the level above.
    """

    def build(t: pa.Table) -> pa.Table:
        z, out = t["z"][0].as_py(), []
        now = {(x, y): unpacked(b, size) for x, y, b in zip(t["x"].to_pylist(), t["y"].to_pylist(), t["block"].to_pylist(), strict=True)}
        for k in range(1, levels + 1):
            canvases: dict = {}
            for (x, y), pixels in now.items():
                canvas = canvases.setdefault((x >> 1, y >> 1), np.zeros((2 * size, 2 * size), np.int32))
                canvas[(y & 1) * size : (y & 1) * size + size, (x & 1) * size : (x & 1) * size + size] = pixels
            means = {at: np.rint(c.reshape(size, 2, size, 2).sum(axis=(1, 3)) / 4) for at, c in canvases.items()}
            now = {at: m for at, m in means.items() if (m > 0).any()}
            out += [(z - k, x, y, packed(m)) for (x, y), m in now.items()]
        return table(out)

    return blocks.groupBy("z", F.shiftright("x", levels), F.shiftright("y", levels)).applyInArrow(build, BLOCKS)


def pyramid(blocks: DataFrame, size: int, top: int = 0) -> DataFrame:
    """All levels of blocks (of one zoom) down to zoom `top`; each step of AT_ONCE levels is committed before the next is made."""
    level = commit(without_sea(blocks), "level")
    zoom = level.agg(F.max("z")).first()[0]
    out = level
    while zoom is not None and zoom > top:
        levels = min(AT_ONCE, zoom - top)
        made = commit(level_up(level, size, levels), "level")
        out, zoom = out.unionByName(made), zoom - levels
        level = made.where(F.col("z") == zoom)
    return out


def children(tiles: DataFrame) -> DataFrame:
    """Parents (pz, px, py) of tiles (z, x, y, value) with their children q in the order (0,0), (1,0), (0,1), (1,1); an absent child is 0.

    One shuffle: the children of a parent meet as the four fields of its row.
    """
    q = (F.col("x") % 2 + F.col("y") % 2 * 2).cast("int")
    own = tiles.select((F.col("z") - 1).alias("pz"), F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py"), q.alias("q"), "value")
    out = own.groupBy("pz", "px", "py").agg(F.array(*[F.max(F.when(F.col("q") == i, F.col("value"))) for i in range(4)]).alias("four"))
    return out.select("pz", "px", "py", F.posexplode("four").alias("q", "value")).select("pz", "px", "py", "q", F.coalesce("value", F.lit(0)).alias("value"))


def parents(tiles: DataFrame) -> DataFrame:
    return tiles.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).distinct()
