"""Vectorised content hashes of words and byte spans, shared by the operators that run in Arrow batches."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@functools.lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U64)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, U64(_BASE)), np.full(size, U64(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads all bits of x."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the byte spans [start, end): eight bytes at a time through the finaliser, no polynomial.

    Spans over 256 bytes go through a keyed BLAKE2b, so that long ones take no more rounds.
    """
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    size = end - start
    h = mix64(size.astype(U64) + U64((seed * 0x9E3779B97F4A7C15) % 2**64))
    todo = np.arange(len(start))
    for d in range(0, 256, 8):
        todo = todo if d == 0 else todo[size[todo] > d]
        if not len(todo):
            break
        left = np.minimum(size[todo] - d, 8)
        h[todo] = mix64(h[todo] ^ (eight[start[todo] + d] & _MASKS[left]))
    for i in np.flatnonzero(size > 256).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=bytes([seed])).digest(), "little")
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from the words' hashes."""
    n = len(words) - k + 1
    h = mix64(words[:n] + U64(k))
    for j in range(1, k):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + words[j : j + n])
    return h


def prefix_hash(a: np.ndarray, seed: int = 1) -> np.ndarray:
    """Prefix sums of a polynomial hash (mod 2^64, a random letter table) over bytes a.

    Long strings of two letters can be made to collide: good for finding candidates, not for telling texts apart.
    """
    out = np.zeros(len(a) + 1, U64)
    np.cumsum(_letters(seed)[a] * powers(len(a))[0][: len(a)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end): equal for equal bytes wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U64))


def word_spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes a whose words are joined by one space."""
    if len(a) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(a == 32)
    return np.concatenate([[0], gaps + 1]).astype(np.int64), np.concatenate([gaps, [len(a)]]).astype(np.int64)


def texts_of(column: pa.ChunkedArray | pa.Array):
    """Iterates over a string column as UTF-8 bytes, null as None, without decoding."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield from (x.as_buffer().to_pybytes() if x.is_valid else None for x in chunk)
