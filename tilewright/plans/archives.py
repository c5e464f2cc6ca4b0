"""Queries of tile archives: an archive for each anchor is derived from the tiles, written, and scanned."""

from __future__ import annotations

import gzip
import struct
import uuid

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from tilewright.functions import addressing as A
from tilewright.functions.vector_tile import put_varint
from tilewright.operators import catalog
from tilewright.plans.addressing import hilbert_sql
from tilewright.plans.fixtures import TILES, map_tiles, with_tables
from tilewright.sources import archive, archive_source
from tilewright.sources.scratch import commit, scratch_path


def directory(rows: list[tuple[int, int, int, int]]) -> bytes:
    ids = [r[0] for r in rows]
    out = put_varint(len(rows)) + b"".join(put_varint(b - a) for a, b in zip([0, *ids], ids, strict=False))
    return out + b"".join(put_varint(r[k]) for k in (1, 2) for r in rows) + b"".join(put_varint(r[3] + 1) for r in rows)


def small_archive(ids: list[int], payloads: list[bytes], leaf: int = 32, metadata: bytes = b'{"name":"OpenMapTiles","vector_layers":[]}', kind: int = 1) -> bytes:
    """A small archive with leaf directories, gzip inside, and consecutive equal tiles as runs."""
    rows: list[list[int]] = []
    data = b""
    for i, p in sorted(zip(ids, payloads, strict=True)):
        if rows and rows[-1][0] + rows[-1][1] == i and data[rows[-1][3] :] == p:
            rows[-1][1] += 1
        else:
            rows.append([i, 1, len(p), len(data)])
            data += p
    leaves, root = b"", []
    for k in range(0, len(rows), leaf):
        part = gzip.compress(directory(rows[k : k + leaf]), mtime=0)
        root.append((rows[k][0], 0, len(part), len(leaves)))
        leaves += part
    root_bytes, meta = gzip.compress(directory(root), mtime=0), gzip.compress(metadata, mtime=0)
    at, sections = archive.HEADER, []
    for part in (root_bytes, meta, leaves, data):
        sections += [at, len(part)]
        at += len(part)
    zoom = lambda i: max(z for z in range(32) if archive.base(z) <= i)
    head = b"PMTiles\x03" + struct.pack("<11Q", *sections, len(ids), len(rows), len(rows)) + bytes([1, 2, 1, kind, zoom(min(ids)), zoom(max(ids))])
    return head.ljust(archive.HEADER, b"\0") + root_bytes + meta + leaves + data


def created(folder: str) -> tuple[FileSystem, str]:
    """The folder's filesystem and its path there; the folder is made if it is missing."""
    fs, root = FileSystem.from_uri("/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder)
    fs.create_dir(root)
    return fs, root


def new_folder(spark) -> str:
    """A new folder for archives; it is there even if no task writes one, so that it can be read as empty."""
    folder = scratch_path(spark, "archives")
    created(folder)
    return folder


def put(folder: str, name: str, body: bytes) -> None:
    """Write a file and move it into place once whole, so that a task may be run again."""
    fs, root = created(folder)
    part = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(body)
    fs.move(part, f"{root}/{name}")


def archives_to_zoom(spark, zooms):
    """The folder of an archive for each zoom of the table (zoom): the world's tile and one of that zoom, z<zoom>.pmtiles."""
    folder = new_folder(spark)

    def build(g: pa.Table) -> pa.Table:
        z = g["zoom"][0].as_py()
        put(folder, f"z{z}.pmtiles", small_archive([0, archive.base(z)], [b"a", b"b"]))
        return pa.table({"zoom": pa.array([z], pa.int32())})

    commit(zooms.select(F.col("zoom").cast("int").alias("zoom")).distinct().groupBy("zoom").applyInArrow(build, "zoom int"), "zooms")
    return folder


def _archives(spark, d, raster=False):
    """The folder of a file for each anchor; those past the date line are numbered on, and hold ids of the map."""
    t = map_tiles(spark, d).where("octet_length(payload) > 0")
    x10, _ = A.anchor(F.col("z"), F.col("x"), F.col("y"))
    t = t.select(A.off_map(x10, F.lit(A.ANCHOR_ZOOM), F.col("world")).alias("x10"), A.hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "payload")
    folder = new_folder(spark)

    def build(g: pa.Table) -> pa.Table:
        x = g["x10"][0].as_py()
        body = small_archive(g["tile_id"].to_pylist(), g["payload"].to_pylist(), kind=(2 if x % 2 == 0 else 4) if raster else 1)
        put(folder, f"anchor-{x}.pmtiles", body)
        return pa.table({"x10": pa.array([x], pa.int64())})

    commit(t.groupBy("x10").applyInArrow(build, "x10 long"), "anchors")
    return folder


def scan_tile_archive(spark, d):
    found = archive_source.scan(spark, _archives(spark, d), named=True).where("z >= 12")
    world = A.world(F.regexp_extract("path", "anchor-([0-9]+)[.]pmtiles$", 1).cast("long"), F.lit(A.ANCHOR_ZOOM))
    return found.select("tile_id", "z", A.off_map(F.col("x"), F.col("z"), world).alias("x"), "y", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("digest"))


def archive_inventory(spark, d):
    found = archive_source.inventory(spark, _archives(spark, d))
    return found.withColumn("path", F.regexp_extract("path", "([^/]+)[.]pmtiles$", 1))


def content_type(spark, d):
    """Raster archives, PNG or WebP by anchor, by the media type their headers give."""
    found = archive_source.inventory(spark, _archives(spark, d, raster=True))
    return found.groupBy(catalog.content_type(F.col("kind")).alias("content_type")).agg(F.count("*").alias("archives"))


QUERIES = {f.__name__: f for f in (scan_tile_archive, archive_inventory, content_type)}
SQL = {
    "scan_tile_archive": with_tables(TILES, "+" + hilbert_sql("tiles", "doc_id") + " SELECT tile_id, z, x, y, octet_length(encode(payload)) AS bytes, sha256(payload) AS digest FROM ided JOIN tiles ON k = doc_id WHERE z >= 12 AND payload <> ''", recursive=True),
    "archive_inventory": with_tables(TILES, """SELECT 'anchor-' || x10 AS path, 'mvt' AS kind, 'gzip' AS internal, 'none' AS compression, min(z)::INTEGER AS min_zoom, max(z)::INTEGER AS max_zoom, 'openmaptiles' AS tile_schema, true AS has_vector_layers
        FROM tiles WHERE payload <> '' GROUP BY x10"""),
    "content_type": with_tables(TILES, "SELECT CASE WHEN x10 % 2 = 0 THEN 'image/png' ELSE 'image/webp' END AS content_type, count(DISTINCT x10) AS archives FROM tiles WHERE payload <> '' GROUP BY 1"),
}
