"""Shared pieces of the vector operators: valid rows, fast Hadamard rotations, local components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(vector: str) -> Column:
    """True for vectors that are not null or zero and hold no null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def signs(d: int, seed: int, rounds: int = 3) -> np.ndarray:
    return np.random.default_rng([seed, d]).choice([-1.0, 1.0], (rounds, d))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of x, padded to a power of two, under three rounds of random signs and the fast Hadamard transform."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    for s in signs(d, seed):
        y *= s
        h = 1
        while h < d:
            z = y.reshape(len(y), d // (2 * h), 2, h)
            y = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(len(y), d)
            h *= 2
        y /= np.sqrt(d)
    return y


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new
    return label
