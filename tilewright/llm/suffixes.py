"""Suffix-array dedup: two-stage suffix sorting of candidate text, then adjacent common prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import anchors
from tilewright.llm.hashing import texts_of
from tilewright.llm.common import materialise

WINDOW = 100
BUCKET_ENTRIES, BUCKET_BYTES = 1_000_000, 12 << 20


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """True for the positions whose suffix is smaller than the one that starts a byte later."""
    if len(t) < 2:
        return np.zeros(len(t), bool)
    cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])  # runs of one byte go by the byte after the run
    after = np.r_[t[cut[1:]], 0].astype(np.int16)
    up = after > t[cut]
    up[-1] = False
    return np.repeat(up, np.diff(np.r_[cut, len(t)]))


def words_at(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number: a view, not a copy."""
    return np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places `at` by their suffixes' first `depth` bytes: eight bytes a round, only ties go on."""
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tied, group = np.arange(len(at)), np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(at) else np.zeros(0, int)
    for d in range(8, depth, 8):
        size = np.bincount(group)
        more = size[group] > 1
        tied, group = tied[more], group[more]
        if not len(tied):
            break
        key = words[at[tied] + d].astype(np.uint64)
        order = np.lexsort((key, group))
        at[tied] = at[tied[order]]
        key, group = key[order], group[order]
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return at


def suffix_order(t: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places marked in `wanted` in the order of their suffixes (to a depth of at least WINDOW bytes).

    First stage: suffixes smaller than their successors are sorted directly. Second stage: buckets of the
    first byte are scanned upwards; each suffix met puts the one that starts a byte earlier, if that is
    larger, at the next free place of its bucket.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(WINDOW + 16, np.uint8)])
    direct = smaller_than_next(t)
    # a larger suffix is induced from its successor: the places needed go on to the next direct one
    stop = np.flatnonzero(direct | (np.arange(n) == n - 1))
    until = stop[np.searchsorted(stop, np.arange(n))]
    mark = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(mark, at, 1)
    np.add.at(mark, until[at] + 1, -1)
    need = np.cumsum(mark[:-1]) > 0
    first = sort_directly(words_at(padded), np.flatnonzero(need & direct), WINDOW + 8)
    start = np.searchsorted(t[first], np.arange(257))
    put: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and need[-1]:  # the last place is induced from the end of the text, which is smaller than every byte
        put[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(put[c]) if put[c] else np.zeros(0, np.int64)
        larger = [level]
        while len(level):  # runs of this byte: one longer each time
            level = level[level > 0] - 1
            level = level[(t[level] == c) & need[level] & ~direct[level]]
            larger.append(level)
        mine = np.concatenate([*larger, first[start[c] : start[c + 1]]])
        out.append(mine)
        before = mine[mine > 0] - 1
        before = before[need[before] & ~direct[before] & (t[before] > c)]
        byte = t[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else []
        for x, y in zip(cut, np.r_[cut[1:], len(byte)].astype(int) if len(byte) else [], strict=True):
            put[int(byte[x])].append(before[x:y])
    order = np.concatenate(out)
    return order[wanted[order]]


def shares_prefix(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in order but the first: whether its suffix has WINDOW bytes in common with the one before."""
    words = words_at(np.concatenate([t, np.zeros(WINDOW + 16, np.uint8)]))
    left = np.arange(len(order) - 1)
    for d in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        left = left[words[order[left] + d] == words[order[left + 1] + d]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[left] = True
    return out


def repeated_windows(data: bytes, size: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the 100-byte windows of pieces (in order of place) that also start earlier."""
    t = np.frombuffer(data, np.uint8)
    begin = np.cumsum(size) - size
    first = np.cumsum(count) - count
    at = np.repeat(begin - first, count) + np.arange(count.sum())
    wanted = np.zeros(len(t), bool)
    wanted[at] = True
    order = suffix_order(t, wanted)
    group = np.cumsum(np.r_[True, ~shares_prefix(t, order)]) - 1
    # pieces come in order of place, so the smallest position of a group is the earliest window
    least = np.minimum.reduceat(order, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
    marked = np.zeros(len(t), bool)
    marked[order] = order != least[group]
    return marked[at]


def remove_repeats(docs: DataFrame, texts: bool = False, hot: int = anchors.HOT) -> DataFrame:
    """Remove every byte covered by a 100-byte string that also starts earlier.

    docs has doc_id and text; other columns are ignored. Earlier is a smaller doc_id or an earlier place in
    the same document. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept
    (bytes, which may cut a character). Strings are judged on the input and overlap. Only text whose
    anchor is shared can repeat, and only that is suffix-sorted (strings under an anchor with more than `hot`
    unlike pieces go by 128-bit digests, as no one task could sort them). A null text is empty; rows of a null
    doc_id are returned whole; rows of equal doc_id count as documents in the order of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, bits = anchors.measure(docs)
    posts = anchors.post(docs, anchors.byte_runs, max(16, total // 30 // BUCKET_ENTRIES), within=True, bits=bits)
    hits = materialise(anchors.shared(posts, hot), "shared")
    buckets = max(16, total // BUCKET_BYTES)
    spans = anchors.judge(anchors.pieces(docs, hits, anchors.byte_runs, buckets, within=True, bits=bits), repeated_windows, within=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def rows(ids, bodies, by) -> pa.Table:
        n, gone, runs, sha, left = [], [], [], [], []
        for i, text in enumerate(bodies):
            text, at, kept = text or b"", 0, []
            spans = anchors.covered(by.get(i), WINDOW)
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            n.append(len(text))
            gone.append(len(text) - len(kept))
            runs.append(len(spans))
            sha.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept": pa.array(left, pa.binary())} if texts else {}))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, bodies = anchors.in_order(left)
        return rows(ids, bodies, anchors.spans_of(right))

    def whole(parts):
        for b in parts:
            yield from rows(b.column("doc_id"), list(texts_of(b.column("text"))), {}).to_batches()

    done = anchors.chunked(docs, bits).groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(apply, schema)
    return done.unionByName(docs.where("doc_id is null").mapInArrow(whole, schema))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of all documents, removed: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
