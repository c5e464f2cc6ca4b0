"""Raster blocks: a row for each tile, its whole metres as little-endian 16-bit numbers, row by row from the north."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.terrain import OFFSET

BLOCKS = "z int, x long, y long, block binary"
PIXELS = "z int, gx long, gy long, metres int"
METRES = np.dtype("<i2")
# An Arrow batch of blocks holds about this many bytes of pixel rows when it is taken apart.
ROWS_AT_ONCE = 1 << 20


def packed(metres: np.ndarray) -> bytes:
    """Metres rounded half to even and clipped to 16 bits."""
    return np.clip(np.rint(metres), -32768, 32767).astype(METRES).tobytes()


def unpacked(block: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(block, METRES)
    if len(out) != size * size:
        raise ValueError(f"a block of {len(block)} bytes is not one of {size} x {size} pixels")
    return out.reshape(size, size)


def table(rows: list[tuple]) -> pa.Table:
    z, x, y, block = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"z": pa.array(z, pa.int32()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "block": pa.array(block, pa.binary())})


def of_pixels(pixels: DataFrame, size: int) -> DataFrame:
    """Blocks of pixels (z, gx, gy, metres) at global pixel coordinates. A missing pixel is 0, of equal ones the highest counts."""

    def tile(t: pa.Table) -> pa.Table:
        gx, gy, metres = (t[c].to_numpy() for c in ("gx", "gy", "metres"))
        out = np.full((size, size), np.iinfo(np.int64).min)
        np.maximum.at(out, (gy % size, gx % size), metres)
        out[out == np.iinfo(np.int64).min] = 0
        return table([(t["z"][0].as_py(), int(gx[0]) // size, int(gy[0]) // size, packed(out))])

    return pixels.groupBy("z", F.floor(F.col("gx") / size), F.floor(F.col("gy") / size)).applyInArrow(tile, BLOCKS)


def to_pixels(blocks: DataFrame, size: int) -> DataFrame:
    """A row for each pixel of each block."""
    at_once = max(1, ROWS_AT_ONCE // (size * size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dy, dx = (a.ravel() for a in np.mgrid[0:size, 0:size])
        for batch in batches:
            for k in range(0, batch.num_rows, at_once):
                part = batch.slice(k, at_once)
                n = part.num_rows
                x, y = (np.repeat(part.column(c).to_numpy(), size * size) for c in ("x", "y"))
                metres = np.concatenate([unpacked(b, size).ravel() for b in part.column("block").to_pylist()])
                z = np.repeat(part.column("z").to_numpy(), size * size)
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x * size + np.tile(dx, n)), pa.array(y * size + np.tile(dy, n)), pa.array(metres.astype(np.int32))], names=["z", "gx", "gy", "metres"])

    return blocks.select("z", "x", "y", "block").mapInArrow(rows, PIXELS)


def statistics(blocks: DataFrame) -> DataFrame:
    """For each block: z, x, y, land (pixels above the sea), total and highest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(b, METRES) for b in batch.column("block").to_pylist()]
            found = [pa.array([int((d > 0).sum()) for d in data], pa.int64()), pa.array([int(d.sum(dtype=np.int64)) for d in data], pa.int64()), pa.array([int(d.max()) for d in data], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("z", "x", "y")] + found, names=["z", "x", "y", "land", "total", "highest"])

    return blocks.select("z", "x", "y", "block").mapInArrow(rows, "z int, x long, y long, land long, total long, highest int")


def without_sea(blocks: DataFrame) -> DataFrame:
    """The blocks with a pixel above the sea: half a metre, which rounds to 0, is sea."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool((np.frombuffer(b, METRES) > 0).any()) for b in batch.column("block").to_pylist()], pa.bool_()))

    return blocks.select("z", "x", "y", "block").mapInArrow(kept, BLOCKS)


def terrarium(blocks: DataFrame) -> DataFrame:
    """Tiles (z, x, y, payload): the colour bytes r and g of each pixel; b is always 0 and left out."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.frombuffer(b, METRES).astype(np.int32) + OFFSET).astype(">u2").tobytes() for b in batch.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("z", "x", "y")), pa.array(out, pa.binary())], names=["z", "x", "y", "payload"])

    return blocks.select("z", "x", "y", "block").mapInArrow(coded, "z int, x long, y long, payload binary")


def of_terrarium(tiles: DataFrame) -> DataFrame:
    """Blocks of tiles (z, x, y, payload) that terrarium() made."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.frombuffer(p, ">u2").astype(np.int32) - OFFSET).astype(METRES).tobytes() for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("z", "x", "y")), pa.array(out, pa.binary())], names=["z", "x", "y", "block"])

    return tiles.select("z", "x", "y", "payload").mapInArrow(decoded, BLOCKS)
