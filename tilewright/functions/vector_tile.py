"""Vector-tile bytes: layer fields, the split by layer, attributes, and a small encoder for derived tiles."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from tilewright.functions.inflate import MAGIC, inflate

MOST_BYTES = 16 << 20
# The layers that the labels part carries.
LABELS = frozenset({"housenumber", "poi"})


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("bad varint")
        c = b[at]
        at += 1
        out |= (c & 127) << shift
        if c < 128:
            if out >> 64:
                raise ValueError("varint too large")
            return out, at
        shift += 7


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def fields(b: bytes) -> Iterator[tuple[int, int, int | bytes, bytes]]:
    """(number, wire type, value, raw bytes with the tag) of each field; ValueError on malformed bytes."""
    at = 0
    while at < len(b):
        start = at
        tag, at = varint(b, at)
        number, wire = tag >> 3, tag & 7
        if number == 0 or number >= 1 << 29:
            raise ValueError("bad field number")
        if wire == 0:
            value, at = varint(b, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = b[at : at + size], at + size
        elif wire == 2:
            size, at = varint(b, at)
            value, at = b[at : at + size], at + size
        else:
            raise ValueError("bad wire type")
        if at > len(b):
            raise ValueError("truncated field")
        yield number, wire, value, b[start:at]


def plain(payload: bytes) -> bytes:
    """The tile's own bytes; ValueError if a stored gzip is damaged or inflates to more than a tile may hold."""
    return inflate(payload, MOST_BYTES) if payload[:2] == MAGIC else payload


def layers(tile: bytes) -> list[tuple[str | None, bytes, bytes]]:
    """(name, payload, raw bytes) of each field of a tile; name is null for fields that are no layers.

    The last name of a layer wins; a layer without a name, or a tile over the limit, is an error.
    """
    if len(tile) > MOST_BYTES:
        raise ValueError("tile too large")
    out = []
    for number, wire, value, raw in fields(tile):
        if number != 3:
            out.append((None, b"", raw))
            continue
        if wire != 2:
            raise ValueError("layer is not a message")
        name = None
        for n, w, v, _ in fields(value):
            if n == 1:
                if w != 2:
                    raise ValueError("layer name is not text")
                name = v.decode("utf-8", "strict")
        if name is None:
            raise ValueError("layer has no name")
        out.append((name, value, raw))
    return out


def split(tile: bytes, labels: Iterable[str] = LABELS) -> tuple[bytes | None, bytes | None]:
    """(structure, labels): fields of the tile by layer name, in order; null for a part without layers."""
    found = layers(tile)
    text = [raw for name, _, raw in found if name in labels]
    rest = [raw for name, _, raw in found if name not in labels]
    has = any(name is not None and name not in labels for name, _, _ in found)
    return (b"".join(rest) if has else None), (b"".join(text) if text else None)


def value_text(raw: bytes) -> str:
    """A value of a layer's table as text, by the field it stands in: text, float, double, whole, signed or boolean."""
    kind, _, x, _ = next(fields(raw), (0, 0, b"", b""))
    if kind in (2, 3):
        return str(struct.unpack("<f" if kind == 2 else "<d", x)[0])
    return x.decode() if kind == 1 else str((x >> 1) ^ -(x & 1)) if kind == 6 else str(bool(x)).lower() if kind == 7 else str(x)


def varints(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = varint(b, at)
        out.append(v)
    return out


def measure(geometry: bytes) -> tuple[int, float]:
    """(points, area in square units) of a feature's drawing commands: 1 moves, 2 draws lines, 7 closes a ring.

    Areas are signed by the direction of their rings, so a hole is taken off; ValueError on commands that are none or cut short.
    """
    todo, at, x, y, points, twice, ring = varints(geometry), 0, 0, 0, 0, 0, []
    while at < len(todo):
        command, count = todo[at] & 7, todo[at] >> 3
        at += 1
        if command == 7 and count == 1:
            twice += sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True))
            ring = []
            continue
        if command not in (1, 2) or count == 0 or at + 2 * count > len(todo):
            raise ValueError("bad drawing command")
        for k in range(at, at + 2 * count, 2):
            x, y = x + ((todo[k] >> 1) ^ -(todo[k] & 1)), y + ((todo[k + 1] >> 1) ^ -(todo[k + 1] & 1))
            if command == 1:
                ring = []
            ring.append((x, y))
        points += count
        at += 2 * count
    return points, abs(twice) / 2


def features(layer: bytes) -> list[tuple[dict[str, str], int, int, float]]:
    """(attributes as text, geometry type, points, size in pixels of a 256 pixel tile: the square root of the area) of each feature."""
    keys, values, found, extent = [], [], [], 4096
    for n, wire, v, _ in fields(layer):
        if n in (2, 3, 4) and wire != 2:
            raise ValueError("feature, key or value is not a message")
        if n == 2:
            found.append(v)
        elif n == 3:
            keys.append(v.decode())
        elif n == 4:
            values.append(value_text(v))
        elif n == 5:
            extent = v
    out = []
    for f in found:
        tags, kind, geometry = [], 0, b""
        for n, wire, v, _ in fields(f):
            if n == 2 and wire == 2:
                tags += varints(v)
            elif n == 3:
                kind = v
            elif n == 4 and wire == 2:
                geometry += v
        if len(tags) % 2 or any(k >= len(keys) for k in tags[::2]) or any(v >= len(values) for v in tags[1::2]):
            raise ValueError("tags outside their tables")
        points, area = measure(geometry)
        out.append(({keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}, kind, points, area**0.5 * 256 / extent if extent else 0.0))
    return out


def message(number: int, value: bytes) -> bytes:
    return put_varint(number << 3 | 2) + put_varint(len(value)) + value


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def square(side: int, points: int) -> bytes:
    """Drawing commands of a square of this side with so many points (4 at least), the others on its first edge."""
    more = max(4, points) - 4
    steps = [(side * (k + 1) // (more + 1) - side * k // (more + 1), 0) for k in range(more + 1)] + [(0, side), (-side, 0)]
    moves = [1 << 3 | 1, 0, 0, len(steps) << 3 | 2, *(zigzag(v) for step in steps for v in step), 1 << 3 | 7]
    return b"".join(put_varint(v) for v in moves)


def encode_layer(name: str, features: list[dict[str, str]], filler: int = 0, geometries: list[bytes] | None = None) -> bytes:
    """One layer field: version 2, name, polygons with attributes and the geometries given, unknown bytes as filler."""
    keys = sorted({k for f in features for k in f})
    values = sorted({v for f in features for v in f.values()})
    body = message(1, name.encode())
    for i, f in enumerate(features):
        tags = b"".join(put_varint(keys.index(k)) + put_varint(values.index(v)) for k, v in f.items())
        body += message(2, message(2, tags) + b"\x18\x03" + (message(4, geometries[i]) if geometries else b""))
    body += b"".join(message(3, k.encode()) for k in keys) + b"".join(message(4, message(1, v.encode())) for v in values)
    return message(3, body + (message(100, bytes(filler)) if filler else b"") + b"\x78\x02")
