"""Tile archives (PMTiles version 3): header, directories and metadata, read by ranges of a file."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

from pyarrow.fs import FileSystem

from tilewright.functions.inflate import inflate
from tilewright.functions.vector_tile import varint

# Fixed values of the public format.
HEADER, ROOT_LIMIT, MOST_ID = 127, 16_384, 1 << 63
TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp"}
COMPRESSIONS = {0: "unknown", 1: "none", 2: "gzip"}
MOST_DIRECTORY, MOST_ENTRIES, MOST_TILE = 8 << 20, 1 << 18, 16 << 20


@dataclass
class Header:
    root: tuple[int, int]
    metadata: tuple[int, int]
    leaves: tuple[int, int]
    data: tuple[int, int]
    internal: str
    compression: str
    kind: str
    min_zoom: int
    max_zoom: int


def parse_header(b: bytes, size: int | None = None) -> Header:
    """ValueError on a wrong magic or version, unsupported compressions or type, bad zooms or sections."""
    if len(b) < HEADER or b[:7] != b"PMTiles" or b[7] != 3:
        raise ValueError("not a version-3 archive")
    n = struct.unpack_from("<11Q", b, 8)
    internal, compression, kind, lo, hi = b[97], b[98], b[99], b[100], b[101]
    if kind not in (1, 2, 4):
        raise ValueError("unsupported tile type")
    if internal not in (1, 2) or compression not in ((1, 2) if kind == 1 else (0, 1, 2)):
        raise ValueError("unsupported compression")
    if lo > hi or hi > 31:
        raise ValueError("bad zoom range")
    parts = [(n[k], n[k + 1]) for k in (0, 2, 4, 6)]
    if parts[0][1] == 0 or parts[0][0] + parts[0][1] > ROOT_LIMIT:
        raise ValueError("bad root directory")
    spans = sorted(p for p in [(0, HEADER), *parts] if p[1])
    if any(a + s > c for (a, s), (c, _) in zip(spans, spans[1:], strict=False)) or (size is not None and spans[-1][0] + spans[-1][1] > size):
        raise ValueError("bad sections")
    name = "none" if compression == 0 else COMPRESSIONS[compression]
    return Header(*parts, COMPRESSIONS[internal], name, TYPES[kind], lo, hi)


def inflated(b: bytes, how: str, most: int = MOST_DIRECTORY) -> bytes:
    """A stored object as plain bytes; ValueError if it is empty or larger than `most`, before or after inflating."""
    if not b or len(b) > most + (1 << 20 if how == "gzip" else 0):
        raise ValueError("object is empty or over its bound")
    return inflate(b, most) if how == "gzip" else b


def parse_directory(b: bytes, leaf_bytes: int, data_bytes: int) -> list[tuple[int, int, int, int]]:
    """(tile_id, run, length, offset) rows, at least one; ids rise, runs do not overlap, entries lie inside their section."""
    count, at = varint(b, 0)
    if not 0 < count <= MOST_ENTRIES or count > (len(b) - at) // 4:
        raise ValueError("bad entry count")
    cols: list[list[int]] = []
    for _ in range(4):
        col = []
        for _ in range(count):
            v, at = varint(b, at)
            col.append(v)
        cols.append(col)
    if at != len(b):
        raise ValueError("trailing bytes in directory")
    out, last, end = [], 0, 0
    for k, (step, run, length, offset) in enumerate(zip(*cols, strict=True)):
        tile = last + step
        if k and step == 0 or tile + run > MOST_ID or (out and out[-1][0] + out[-1][1] > tile):
            raise ValueError("entries are not in order")
        if length == 0 or (offset == 0 and k == 0):
            raise ValueError("bad entry")
        start = end if offset == 0 else offset - 1
        if start + length > (data_bytes if run else leaf_bytes):
            raise ValueError("entry outside its section")
        out.append((tile, run, length, start))
        last, end = tile, start + length
    return out


def opened(path: str):
    """The file, open for reads of ranges, through Arrow's filesystems (local, HDFS, S3, GCS)."""
    at = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    fs, name = FileSystem.from_uri(at)
    return fs.open_input_file(name)


def span(f, at: int, n: int) -> bytes:
    out = f.read_at(n, at)
    if len(out) != n:
        raise ValueError("truncated archive")
    return out


def read_header(f, size: int) -> Header:
    return parse_header(span(f, 0, min(HEADER, size)), size)


def base(z: int) -> int:
    return ((1 << (2 * z)) - 1) // 3


def described(text: str) -> tuple[str, bool]:
    """Schema name and whether layers are described, by an archive's metadata; ("", False) where it is no such JSON."""
    try:
        meta = json.loads(text)
    except ValueError:
        return "", False
    if not isinstance(meta, dict) or not isinstance(meta.get("name", ""), str | None):
        return "", False
    return "openmaptiles" if "openmaptiles" in text.lower() else (meta.get("name") or "").lower(), meta.get("vector_layers") is not None


def describe(f, size: int) -> tuple:
    """kind, internal, compression, min_zoom, max_zoom, tile_schema, has_vector_layers: header and metadata are all that is read."""
    h = read_header(f, size)
    text = inflated(span(f, *h.metadata), h.internal).decode("utf-8", "replace") if h.metadata[1] else ""
    return (h.kind, h.internal, h.compression, h.min_zoom, h.max_zoom, *described(text))
