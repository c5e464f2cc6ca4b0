"""Tile archives as data sources of Spark: spark.read.format("tile_archive").load(path), and "tile_archive_inventory".

Filters on z and tile_id are pushed down: they become one interval of ids, and leaf directories outside it are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tilewright.sources import archive as A

SCHEMA = "tile_id long, z int, x long, y long, payload binary, bytes int, gzipped boolean"
INVENTORY = "path string, kind string, internal string, compression string, min_zoom int, max_zoom int, tile_schema string, has_vector_layers boolean"
DEPTH = 3  # levels of leaf directories
#: Bytes of tile data that one task reads, as far as a root tells; that one read fetches; and that it may skip over.
BLOCK, READ, GAP = 64 << 20, 8 << 20, 64 << 10
BATCH = 1024  # rows


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files under a folder but hidden ones."""
    at = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    fs, name = FileSystem.from_uri(at)
    info = fs.get_file_info(name)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == FileType.File else [i for i in fs.get_file_info(FileSelector(name, recursive=True)) if i.type == FileType.File and i.base_name[0] not in "._"]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + i.path, i.size) for i in found)


def grouped(items: list, size_of, most: int) -> Iterator[list]:
    """Consecutive items whose sizes sum to `most`, or one that is larger."""
    held, total = [], 0
    for item in items:
        if held and total + size_of(item) > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += size_of(item)
    if held:
        yield held


@dataclass
class Files(InputPartition):
    """Whole files (path, size), or of a large one the root's entries (tile_id, run, length, offset, last id under it)."""

    files: list[tuple[str, int]]
    entries: list[tuple] | None = None


def files_of(partition: Files | None) -> list[tuple[str, int]]:
    """The files of a partition; where partitions() finds none, Spark reads one that is None."""
    return [] if partition is None else partition.files


def within(rows: list[tuple], upper: int, low: int, high: int) -> list[tuple]:
    """Directory rows that touch the ids [low, high), each with the last id under it."""
    out = []
    for k, (tile, run, length, offset) in enumerate(rows):
        after = tile + run if run else rows[k + 1][0] if k + 1 < len(rows) else upper
        if tile < high and after > low:
            out.append((tile, run, length, offset, after - 1))
    return out


def coordinates(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, x, y of Hilbert ids."""
    bases = np.array([A.base(k) for k in range(32)], np.int64)
    z = np.searchsorted(bases, ids, side="right") - 1
    t, x, y = ids - bases[z], np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for k in range(int(z.max(initial=0))):
        s = np.int64(1 << k)
        rx = (t >> 1) & 1
        ry = (t & 1) ^ rx
        fx, fy = np.where(rx == 1, s - 1 - x, x), np.where(rx == 1, s - 1 - y, y)
        live = z > k
        x, y = np.where(live, np.where(ry == 0, fy, x) + s * rx, x), np.where(live, np.where(ry == 0, fx, y) + s * ry, y)
        t = t >> 2
    return z, x, y


class TileArchive(DataSource):
    """Rows of SCHEMA: the tiles of archives, runs expanded, in the order of their ids within a file.

    Options: path, a file or a folder; payload ("true"): with "false" no tile data are read and payload is null; named
    ("false"): with "true" each row also names its file (path). A damaged archive raises; it never yields part of its rows silently.
    """

    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        return f"{SCHEMA}, path string" if self.named else SCHEMA

    @property
    def named(self) -> bool:
        return self.options.get("named", "false").lower() == "true"

    def reader(self, schema) -> TileArchiveReader:
        return TileArchiveReader(self.options["path"], self.options.get("payload", "true").lower() != "false", named=self.named)


class TileArchiveReader(DataSourceReader):
    def __init__(self, path: str, payload: bool = True, block: int = BLOCK, named: bool = False):
        self.path, self.payload, self.block, self.named = path, payload, block, named
        self.low, self.high = 0, A.MOST_ID

    def pushFilters(self, filters):
        """Takes comparisons of z and tile_id with a number, which become an interval of ids; all others are left to Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if isinstance(f, IsNotNull) and column in (("z",), ("tile_id",)):
                continue  # they never are null
            if column not in (("z",), ("tile_id",)) or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or not isinstance(value, int):
                yield f
                continue
            # the first id of the value, and the first after it
            first, after = (A.base(min(max(value, 0), 32)), A.base(min(max(value + 1, 0), 32))) if column == ("z",) else (value, value + 1)
            if isinstance(f, EqualTo | GreaterThanOrEqual):
                self.low = max(self.low, first)
            if isinstance(f, EqualTo | LessThanOrEqual):
                self.high = min(self.high, after)
            if isinstance(f, GreaterThan):
                self.low = max(self.low, after)
            if isinstance(f, LessThan):
                self.high = min(self.high, first)

    def partitions(self) -> list[Files]:
        """Small files together; a large one by its root, which is read here (16 KiB at most), without what the filters rule out."""
        if self.low >= self.high:
            return []
        found = listed(self.path)
        out = [Files(held) for held in grouped([f for f in found if f[1] <= self.block], lambda f: f[1], self.block)]
        for path, size in found:
            if size > self.block:
                with A.opened(path) as f:
                    h, root = self.root(f, size)
                each = h.data[1] // len(root)
                out += [Files([(path, size)], held) for held in grouped(within(root, A.MOST_ID, self.low, self.high), lambda e: e[2] if e[1] else each, self.block)]  # noqa: B023
        return out

    @staticmethod
    def root(f, size: int) -> tuple[A.Header, list]:
        h = A.read_header(f, size)
        return h, A.parse_directory(A.inflated(A.span(f, *h.root), h.internal), h.leaves[1], h.data[1])

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for path, size in files_of(partition):
            with A.opened(path) as f:
                if partition.entries is None:
                    h, root = self.root(f, size)
                    entries = within(root, A.MOST_ID, self.low, self.high)
                else:
                    h, entries = A.read_header(f, size), partition.entries
                for batch in self.tiles(f, h, self.tile_entries(f, h, entries)):
                    yield batch.append_column("path", pa.array([path] * batch.num_rows, pa.string())) if self.named else batch

    def tile_entries(self, f, h: A.Header, entries: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        """(tile_id, run, length, offset) of tiles in the order of ids; leaves are read when their turn comes."""
        todo = [(*e, 0) for e in reversed(entries)]
        while todo:
            tile, run, length, offset, last, depth = todo.pop()
            if run:
                yield tile, run, length, offset
                continue
            if depth == DEPTH:
                raise ValueError("directories are too deep")
            leaf = A.parse_directory(A.inflated(A.span(f, h.leaves[0] + offset, length), h.internal), h.leaves[1], h.data[1])
            if leaf[0][0] < tile or max(leaf[-1][0], leaf[-1][0] + leaf[-1][1] - 1) > last:
                raise ValueError("leaf outside its interval")
            todo += [(*e, depth + 1) for e in reversed(within(leaf, last + 1, self.low, self.high))]

    def tiles(self, f, h: A.Header, entries: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ids, payloads, sizes, held = [], [], [], 0
        for start, data, near in self.fetched(f, h, entries):
            for tile, run, length, offset in near:
                payload = data[offset - start : offset - start + length] if self.payload else None
                for k in range(max(tile, self.low), min(tile + run, self.high)):
                    ids.append(k)
                    payloads.append(payload)
                    sizes.append(length)
                    held += length if self.payload else 0
                    if len(ids) == BATCH or held >= READ:
                        yield self.batch(ids, payloads, sizes, h)
                        ids, payloads, sizes, held = [], [], [], 0
        if ids:
            yield self.batch(ids, payloads, sizes, h)

    def fetched(self, f, h: A.Header, entries: Iterator[tuple]) -> Iterator[tuple[int, bytes, list]]:
        """Entries that stand close together, with the bytes from the first of them on: one read each."""
        near, start, end = [], 0, 0
        for e in entries:
            at, stop = e[3], e[3] + e[2]
            if e[2] > A.MOST_TILE:
                raise ValueError("tile over its bound")
            if near and (at < start or at > end + GAP or max(end, stop) - start > READ or len(near) == 4 * BATCH):
                yield start, A.span(f, h.data[0] + start, end - start) if self.payload else b"", near
                near = []
            if not near:
                start, end = at, stop
            near.append(e)
            end = max(end, stop)
        if near:
            yield start, A.span(f, h.data[0] + start, end - start) if self.payload else b"", near

    def batch(self, ids: list[int], payloads: list, sizes: list[int], h: A.Header) -> pa.RecordBatch:
        at = np.array(ids, np.int64)
        z, x, y = coordinates(at)
        columns = [pa.array(at), pa.array(z.astype(np.int32)), pa.array(x), pa.array(y), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int32()), pa.array([h.compression == "gzip"] * len(ids), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class TileArchiveInventory(DataSource):
    """A row of INVENTORY for each archive under the path: type, compressions, zooms, schema name, whether layers are described."""

    @classmethod
    def name(cls) -> str:
        return "tile_archive_inventory"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(self.options["path"])


class InventoryReader(DataSourceReader):
    FILES = 256  # of a task

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        return [Files(held) for held in grouped(listed(self.path), lambda _: 1, self.FILES)]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        for path, size in files_of(partition):
            with A.opened(path) as f:
                yield (path, *A.describe(f, size))


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, and let it push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileArchive)
    spark.dataSource.register(TileArchiveInventory)


def scan(spark: SparkSession, path: str, payload: bool = True, named: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("tile_archive").option("payload", str(payload).lower()).option("named", str(named).lower()).load(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("tile_archive_inventory").load(path)
