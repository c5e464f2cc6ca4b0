"""Content-defined anchors: which windows of documents can be equal at all, found by a sparse exchange.

The anchor of a window is the least hash of the short grams in it. Equal windows have equal anchors, and
neighbouring windows mostly share one, so anchors are few. Documents are dealt into chunks by doc_id; a
chunk posts each of its anchors once, so an anchor that a third of all documents hold is one entry for each chunk.
Text under an anchor is one piece for each surrounding it stands in. An anchor of very many unlike pieces is hot:
its windows go by 128-bit digests of their own, dealt out by digest, so no task gets all that share it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.hashing import prefix_hash, span_hash, texts_of, word_spans

CHUNK_BITS, CHUNK_BYTES = 10, 8 << 20  # doc_ids of a chunk, fewer where documents are long on average
HOT = 8_192  # unlike pieces of an anchor from which on its windows are dealt out by digest
WINDOWS = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("start", "<i4")])


@dataclass
class Runs:
    """A document's windows, as runs of consecutive windows of the same anchor.

    body: the bytes that windows are cut from; begin, stop: bytes of each window; start, count: first window
    and number of windows of each run; anchor: its value; lo, hi: the run's bytes in body; piece: their hash;
    repeats: a run that holds its anchor twice.
    """

    body: bytes
    begin: np.ndarray
    stop: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    piece: np.ndarray
    repeats: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def _none(body: bytes) -> Runs:
    none = np.zeros(0, np.int64)
    return Runs(body, none, none, none, none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(bool))


def _runs(body: bytes, prefix: np.ndarray, g: np.ndarray, start: np.ndarray, end: np.ndarray, wide: int) -> Runs:
    """g: hashes of the grams; start, end: bytes of each window, which holds `wide` grams."""
    m = sliding_min(g, wide)
    cut = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else np.zeros(0, np.int64)
    count = np.diff(np.r_[cut, len(m)])
    # a gram is an anchor if the largest minimum of the windows that hold it is its own hash
    pad = np.zeros(wide - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([pad, m, pad]), wide)
    at = np.flatnonzero(most == g)
    low, high = np.searchsorted(at, cut), np.searchsorted(at, cut + count - 1 + wide)
    run = np.repeat(np.arange(len(cut)), high - low)
    which = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[run]
    times = np.bincount(run, weights=g[at[which]] == m[cut][run], minlength=len(cut))
    lo, hi = start[cut], end[cut + count - 1]
    return Runs(body, start, end, cut, count, m[cut], lo, hi, span_hash(prefix, lo, hi), times > 1)


def word_runs(text: bytes | None, window: int = 13, gram: int = 6) -> Runs:
    body = b" ".join((text or b"").split())
    a = np.frombuffer(body, np.uint8)
    start, end = word_spans(a)
    if len(start) < window:
        return _none(body)
    prefix = prefix_hash(a)
    g = span_hash(prefix, start[: len(start) - gram + 1], end[gram - 1 :])
    wide = window - gram + 1
    return _runs(body, prefix, g, start[: len(start) - window + 1], end[window - 1 :], wide)


def byte_runs(text: bytes | None, window: int = 100, gram: int = 32) -> Runs:
    body = text or b""
    if len(body) < window:
        return _none(body)
    a = np.frombuffer(body, np.uint8)
    at = np.arange(len(a) - gram + 1)
    prefix = prefix_hash(a)
    g = span_hash(prefix, at, at + gram)
    wide = window - gram + 1
    at = np.arange(len(g) - wide + 1)
    return _runs(body, prefix, g, at, at + window, wide)


def split_by(of: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """rows by the values of `of`, in one sort."""
    order = np.argsort(of, kind="stable")
    values, cut = np.unique(of[order], return_index=True)
    return [(int(v), rows[order[x:y]]) for v, x, y in zip(values, cut, np.append(cut, len(of))[1:], strict=True)]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def chunked(docs: DataFrame, bits: int) -> DataFrame:
    return docs.select(F.shiftright(F.col("doc_id"), bits).alias("chunk"), "doc_id", "text").where("doc_id is not null")


def measure(docs: DataFrame) -> tuple[int, int]:
    """(bytes of all texts, doc_id bits of a chunk: about CHUNK_BYTES of text, and 1,024 doc_ids at most)."""
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return total, int(max(0, min(CHUNK_BITS, np.log2(CHUNK_BYTES * max(1, rows) / max(1, total)))))


POSTS = "bucket int, chunk long, keys binary, many binary"


def post(docs: DataFrame, runs, buckets: int, within: bool, bits: int) -> DataFrame:
    """Anchors by bucket and chunk: sorted distinct keys, the number of unlike pieces of each, and whether the chunk itself holds a key more than once.

    within: a second place in the same document counts as well as one in another document. `many` is
    twice the number of unlike pieces (at most 32,767), plus 1 where the key comes again.
    """

    def run(batches):
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            texts = list(texts_of(b.column("text")))
            out = []
            for c in np.unique(chunk):
                keys, times, every, kind = [], [], [], []
                for i in np.flatnonzero(chunk == c):
                    r = runs(texts[i])
                    k, n = np.unique(r.anchor, return_counts=True)
                    if within:
                        n[np.searchsorted(k, r.anchor[r.repeats])] = 2
                    keys.append(k)
                    times.append(n if within else np.ones(len(k), np.int64))
                    every.append(r.anchor)
                    kind.append(r.piece)
                k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                many = np.bincount(inverse, weights=np.concatenate(times), minlength=len(k)) > 1
                every, kind = np.concatenate(every), np.concatenate(kind)
                order = np.lexsort((kind, every))
                every, kind = every[order], kind[order]
                unlike = np.r_[True, (every[1:] != every[:-1]) | (kind[1:] != kind[:-1])] if len(every) else np.zeros(0, bool)
                kinds = np.bincount(np.searchsorted(k, every[unlike]), minlength=len(k))
                many = (np.minimum(kinds, 32_767) * 2 + many).astype(np.uint16)
                for at, mine in split_by(bucket_of(k, buckets), np.arange(len(k))):
                    out.append({"bucket": at, "chunk": int(c), "keys": k[mine].tobytes(), "many": many[mine].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())]))

    return chunked(docs, bits).mapInArrow(run, POSTS)


def entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, chunks, many) of posted rows, sorted by key."""
    blobs = t["keys"].to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    many = np.frombuffer(b"".join(t["many"].to_pylist()), np.uint16)
    if "chunks" in t.column_names:
        chunks = np.frombuffer(b"".join(t["chunks"].to_pylist()), np.int64)
    else:
        chunks = np.repeat(t["chunk"].to_numpy(), [len(x) // 8 for x in blobs])
    order = np.argsort(keys, kind="stable")
    return keys[order], chunks[order], many[order]


HITS = "chunk long, keys binary, hot binary"


def hits_by_chunk(keys: np.ndarray, chunks: np.ndarray, hot: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    order = np.argsort(chunks, kind="stable")
    keys, chunks, hot = keys[order], chunks[order], hot[order]
    cut = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]) if len(chunks) else []
    return [(int(chunks[x]), keys[x:y].tobytes(), hot[x:y].tobytes()) for x, y in zip(cut, np.r_[cut[1:], len(chunks)].astype(int) if len(chunks) else [], strict=True)]


def repeated(keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Entries (sorted by key) whose key several chunks hold, or one chunk more than once."""
    same = keys[1:] == keys[:-1]
    twice = many & 1 == 1
    return twice | np.r_[False, same] | np.r_[same, False] if len(keys) else twice


def shared(posts: DataFrame, hot: int = HOT) -> DataFrame:
    """HITS: the anchors of each chunk that can belong to equal windows, and whether they are hot."""

    def run(t: pa.Table) -> pa.Table:
        keys, chunks, many = entries(t)
        hit = repeated(keys, many)
        of = np.unique(keys, return_inverse=True)[1]
        crowd = np.bincount(of, weights=many >> 1)[of] > hot
        found = hits_by_chunk(keys[hit], chunks[hit], crowd[hit])
        return pa.table({"chunk": pa.array([c for c, _, _ in found], pa.int64()), "keys": pa.array([k for _, k, _ in found], pa.binary()), "hot": pa.array([h for _, _, h in found], pa.binary())})

    return posts.groupBy("bucket").applyInArrow(run, HITS)


PIECES = "bucket int, chunk long, row binary, doc binary, start binary, count binary, size binary, data binary, gone binary, windows binary"


def in_order(t: pa.Table) -> tuple[np.ndarray, list[bytes | None]]:
    """doc_ids and texts of a chunk, in an order that any task finds again."""
    ids, texts = t["doc_id"].to_numpy(), list(texts_of(t["text"]))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b""))
    return ids[order], [texts[i] for i in order]


def pieces(docs: DataFrame, hits: DataFrame, runs, buckets: int, within: bool, bits: int) -> DataFrame:
    """Bytes of all runs whose anchor is shared, by bucket of the anchor; of hot anchors, the digests of their windows.

    A piece that the chunk holds earlier is not sent again: all its windows are repeats, so its run
    goes along as (row, first window, windows) in `gone`. Earlier is a smaller doc_id, or, with `within`,
    an earlier place.
    """

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known, inverse = np.unique(np.frombuffer(b"".join(right["keys"].to_pylist()), np.uint64), return_inverse=True)
        hot = np.bincount(inverse, weights=np.frombuffer(b"".join(right["hot"].to_pylist()), bool), minlength=len(known)) > 0
        ids, texts = in_order(left)
        chunk = left["chunk"][0].as_py() if len(left) else 0
        seen, gone, sent, met, single = {}, [], {}, {}, []
        for row, text in enumerate(texts):
            if not len(known):
                break
            r = runs(text)
            at = np.minimum(np.searchsorted(known, r.anchor), len(known) - 1)
            for i in np.flatnonzero(known[at] == r.anchor).tolist():
                data = r.body[r.lo[i] : r.hi[i]]
                first = seen.setdefault(data, row)
                if ids[first] < ids[row] or (within and first != row):
                    gone.append((row, r.start[i], r.count[i]))
                    continue
                if within and first == row and seen.get((data, row)):
                    gone.append((row, r.start[i], r.count[i]))
                    continue
                if within:
                    seen[(data, row)] = True
                if hot[at[i]]:
                    for w in range(r.start[i], r.start[i] + r.count[i]):
                        digest = hashlib.blake2b(r.body[r.begin[w] : r.stop[w]], digest_size=16).digest()
                        first = met.setdefault(digest, (row, w))
                        if ids[first[0]] < ids[row] or (within and first != (row, w)):
                            gone.append((row, w, 1))
                        else:
                            single.append((digest, ids[row], row, w))
                    continue
                sent.setdefault(int(bucket_of(r.anchor[i : i + 1], buckets)[0]), []).append((row, ids[row], r.start[i], r.count[i], data))
        out = []
        if gone:
            out.append((int(chunk) % buckets, [], np.array(gone, np.int64).tobytes(), b""))
        out += [(b, x, b"", b"") for b, x in sent.items()]
        if single:
            each = np.zeros(len(single), WINDOWS)
            each["a"], each["b"] = np.frombuffer(b"".join(d for d, _, _, _ in single), np.uint64).reshape(-1, 2).T
            each["doc"], each["row"], each["start"] = np.array([s[1:] for s in single], np.int64).T
            out += [(b, [], b"", w.tobytes()) for b, w in split_by(bucket_of(each["a"], buckets), each)]
        col = lambda k: pa.array([np.array([p[k] for p in x], np.int64).tobytes() for _, x, _, _ in out], pa.binary())
        return pa.table({
            "bucket": pa.array([b for b, _, _, _ in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int64()), "row": col(0), "doc": col(1), "start": col(2), "count": col(3),
            "size": pa.array([np.array([len(p[4]) for p in x], np.int64).tobytes() for _, x, _, _ in out], pa.binary()),
            "data": pa.array([b"".join(p[4] for p in x) for _, x, _, _ in out], pa.binary()), "gone": pa.array([g for _, _, g, _ in out], pa.binary()), "windows": pa.array([w for _, _, _, w in out], pa.binary()),
        })

    return chunked(docs, bits).groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(cut, PIECES)


SPANS = "chunk long, spans binary"


def judge(found: DataFrame, repeats, within: bool) -> DataFrame:
    """(chunk, spans): runs of windows that stand earlier elsewhere, as (row, first window, windows) triples.

    repeats(data, size, count, order) gets the distinct pieces of a bucket and marks their repeated windows.
    """

    def run(t: pa.Table) -> pa.Table:
        num = lambda c: np.frombuffer(b"".join(t[c].to_pylist()), np.int64)
        row, doc, start, count, size = (num(c) for c in ("row", "doc", "start", "count", "size"))
        chunk = np.repeat(t["chunk"].to_numpy(), [len(x) // 8 for x in t["row"].to_pylist()])
        data = b"".join(t["data"].to_pylist())
        end = np.cumsum(size)
        order = np.lexsort((start, row, doc))
        seen, keep, out = {}, [], {}
        for i in order.tolist():
            piece = data[end[i] - size[i] : end[i]]
            first = seen.setdefault(piece, i)
            if first != i and (within or doc[first] < doc[i]):
                out.setdefault(int(chunk[i]), []).append(np.array([[row[i], start[i], count[i]]], np.int64))
            else:
                keep.append(i)
        keep = np.array(keep, np.int64)
        if len(keep):
            body = b"".join(data[end[i] - size[i] : end[i]] for i in keep.tolist())
            flag = repeats(body, size[keep], count[keep], np.unique(doc[keep], return_inverse=True)[1])
            # runs of marked windows, cut where a piece ends
            piece = np.repeat(np.arange(len(keep)), count[keep])
            first = np.cumsum(count[keep]) - count[keep]
            begin = np.flatnonzero(flag & (np.r_[True, ~flag[:-1]] | (np.arange(len(flag)) == first[piece])))
            stop = np.flatnonzero(flag & (np.r_[~flag[1:], True] | (np.arange(len(flag)) == first[piece] + count[keep][piece] - 1)))
            who = keep[piece[begin]]
            spans = np.stack([row[who], start[who] + begin - first[piece[begin]], stop - begin + 1], axis=1)
            for c, mine in split_by(chunk[who], spans):
                out.setdefault(c, []).append(mine)
        blobs = t["windows"].to_pylist()
        each = np.frombuffer(b"".join(blobs), WINDOWS)
        if len(each):
            of = np.repeat(t["chunk"].to_numpy(), [len(x) // WINDOWS.itemsize for x in blobs])
            order = np.lexsort((each["start"], each["row"], each["doc"], each["b"], each["a"]))
            each, of = each[order], of[order]
            new = np.r_[True, (each["a"][1:] != each["a"][:-1]) | (each["b"][1:] != each["b"][:-1])]
            again = ~new if within else each["doc"] > each["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
            spans = np.stack([each["row"], each["start"], np.ones(len(each), np.int64)], axis=1)
            for c, mine in split_by(of[again], spans[again]):
                out.setdefault(c, []).append(mine)
        rows = [(c, np.concatenate(x).astype(np.int64).tobytes()) for c, x in out.items()]
        rows += [(c, g) for c, g in zip(t["chunk"].to_pylist(), t["gone"].to_pylist(), strict=True) if g]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "spans": pa.array([s for _, s in rows], pa.binary())})

    return found.groupBy("bucket").applyInArrow(run, SPANS)


def spans_of(right: pa.Table) -> dict[int, np.ndarray]:
    """Of a chunk: by row, its (first window, windows) pairs, sorted."""
    s = np.frombuffer(b"".join(right["spans"].to_pylist()), np.int64).reshape(-1, 3)
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    cut = np.flatnonzero(np.r_[True, s[1:, 0] != s[:-1, 0]]) if len(s) else np.zeros(0, np.int64)
    return {int(s[x, 0]): s[x:y, 1:] for x, y in zip(cut, np.r_[cut[1:], len(s)].astype(int), strict=True)} if len(s) else {}


def covered(spans: np.ndarray | None, window: int) -> list[tuple[int, int]]:
    """Maximal covered stretches [a, b) of units, from (first window, windows) pairs."""
    out: list[tuple[int, int]] = []
    for a, n in [] if spans is None else spans.tolist():
        b = a + n - 1 + window
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
