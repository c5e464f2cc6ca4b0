"""Gzip members whose size is checked while they are inflated, not after."""

from __future__ import annotations

import zlib

MAGIC = b"\x1f\x8b"


def inflate(data: bytes, most: int) -> bytes:
    """The bytes of one or more gzip members; ValueError if they are damaged, cut short, or inflate to more than `most`."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data, most + 1))
        except zlib.error as e:
            raise ValueError(f"damaged gzip: {e}") from e
        most -= len(out[-1])
        if most < 0:
            raise ValueError("inflates to more than its bound")
        if not member.eof:
            raise ValueError("gzip is cut short")
        data = member.unused_data
    return b"".join(out)
