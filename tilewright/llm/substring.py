"""Substring dedup: a log-structured index of window fingerprints, merge-joined with each new batch."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import anchors
from tilewright.llm.common import drop_scratch, materialise, scratch_path
from tilewright.llm.hashing import prefix_hash, span_hash, texts_of, word_spans

WINDOW = 13
# Entries of a bucket of the index and bytes of a bucket of pieces that a task is to hold.
BUCKET_ENTRIES, BUCKET_BYTES = 1_000_000, 12 << 20
RUN = "bucket int, keys binary, chunks binary, many binary"
MERGED = "kind string, bucket int, chunk long, keys binary, hot binary, chunks binary, many binary"


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in the shared folder, by bucket.

    An entry is (fingerprint, chunk of documents, number of unlike pieces and whether the chunk holds it
    more than once). Adding a batch merge-joins its entries with every run, reports the chunks, old and new,
    that share a fingerprint, and writes the batch as a new run; `fanout` runs of a level are merged into
    one of the next. save() names the runs in a manifest, from which open() goes on in another session; from then on
    each batch ends with a new version of the manifest, and merged runs are deleted only after it. So a job lost
    at any time leaves an index that opens, as it was before or after the batch. One session writes at a time.
    """

    def __init__(self, spark: SparkSession, buckets: int, bits: int = anchors.CHUNK_BITS, fanout: int = 2, hot: int = anchors.HOT):
        self.spark, self.buckets, self.bits, self.fanout, self.hot = spark, buckets, bits, fanout, hot
        self.runs: list[tuple[int, DataFrame]] = []
        self.retired: list[DataFrame] = []
        self.manifest, self.version = None, 0
        self.last: int | None = None  # the largest doc_id

    def save(self, path: str) -> None:
        """Write the manifest, a row for each run with the index's parameters, as the next version under path."""
        self.version = self.version + 1 if path == self.manifest else max(self.versions(self.spark, path), default=0) + 1
        self.manifest = path
        rows = [(n, r.inputFiles()[0].rsplit("/", 1)[0], self.last, self.buckets, self.bits, self.fanout, self.hot) for n, r in self.runs]
        rows = rows or [(None, None, self.last, self.buckets, self.bits, self.fanout, self.hot)]
        self.spark.createDataFrame(rows, "level int, path string, last long, buckets int, bits int, fanout int, hot int").coalesce(1).write.parquet(f"{path}/version={self.version}")
        self.clean()

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions of a manifest that were written to their end."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        version = max(cls.versions(spark, path))
        rows = spark.read.parquet(f"{path}/version={version}").collect()
        out = cls(spark, *rows[0][3:])
        out.runs = [(r["level"], spark.read.schema(RUN).parquet(r["path"])) for r in rows if r["path"]]
        out.manifest, out.version, out.last = path, version, rows[0]["last"]
        return out

    def clean(self) -> None:
        """Delete runs that were merged into others and that the manifest, if there is one, no longer names."""
        for r in self.retired:
            drop_scratch(r)
        self.retired = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch of documents; returns HITS: fingerprints that became shared.

        Its doc_ids must follow those indexed before, and start a new chunk: ValueError otherwise.
        """
        limit = self.hot
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and self.last is not None and low >> self.bits <= self.last >> self.bits:
            raise ValueError(f"doc_id {low} does not follow the chunk of {self.last}")
        posts = anchors.post(docs, anchors.word_runs, self.buckets, within=False, bits=self.bits)
        past = None
        for _, run in self.runs:
            past = run if past is None else past.unionByName(run)
        if past is None:
            past = self.spark.createDataFrame([], RUN)

        def merge(new: pa.Table, old: pa.Table) -> pa.Table:
            keys, chunks, many = anchors.entries(new)
            hit = anchors.repeated(keys, many)
            one, of = np.unique(keys, return_inverse=True)
            pieces = np.bincount(of, weights=many >> 1, minlength=len(one))
            told = []
            for i in range(len(old)):
                run, held, times = anchors.entries(old.slice(i, 1))
                if not len(keys) or not len(run):
                    continue
                at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
                hit = hit | (run[at] == keys)
                back = np.minimum(np.searchsorted(one, run), len(one) - 1)
                met = one[back] == run
                pieces += np.bincount(back[met], weights=times[met] >> 1, minlength=len(one))
                told.append((run[met], held[met], back[met]))
            told.append((keys[hit], chunks[hit], of[hit]))
            found = anchors.hits_by_chunk(np.concatenate([k for k, _, _ in told]), np.concatenate([c for _, c, _ in told]), np.concatenate([(pieces > limit)[b] for _, _, b in told]))
            n, made = len(found), int(len(keys) > 0)
            null, bucket = [None] * n, [new["bucket"][0].as_py()] * made if made else []
            return pa.table({
                "kind": pa.array(["hit"] * n + ["run"] * made, pa.string()), "bucket": pa.array(null + bucket, pa.int32()),
                "chunk": pa.array([c for c, _, _ in found] + [None] * made, pa.int64()), "keys": pa.array([k for _, k, _ in found] + [keys.tobytes()] * made, pa.binary()),
                "hot": pa.array([h for _, _, h in found] + [None] * made, pa.binary()), "chunks": pa.array(null + [chunks.tobytes()] * made, pa.binary()), "many": pa.array(null + [many.tobytes()] * made, pa.binary()),
            })

        path = scratch_path(self.spark, "index")
        posts.groupBy("bucket").cogroup(past.groupBy("bucket")).applyInArrow(merge, MERGED).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        kinds = {r["kind"] for r in self.spark.read.schema(MERGED).parquet(path).select("kind").distinct().collect()}
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(f"{path}/kind={kind}") if kind in kinds else self.spark.createDataFrame([], schema)
        self.last = self.last if high is None else high
        if "run" in kinds:
            self.runs.append((0, read("run", RUN)))
            self.compact()
        if self.manifest:
            self.save(self.manifest)
        self.clean()
        return read("hit", anchors.HITS)

    def compact(self) -> None:
        level = 0
        while sum(n == level for n, _ in self.runs) >= self.fanout:
            mine = [r for n, r in self.runs if n == level]
            every = mine[0]
            for r in mine[1:]:
                every = every.unionByName(r)

            def merge(t: pa.Table) -> pa.Table:
                keys, chunks, many = anchors.entries(t)
                return pa.table({"bucket": t["bucket"].slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "chunks": pa.array([chunks.tobytes()], pa.binary()), "many": pa.array([many.tobytes()], pa.binary())})

            path = scratch_path(self.spark, "index")
            merged = every.groupBy("bucket").applyInArrow(merge, every.schema)
            merged.write.option("compression", "zstd").parquet(path)
            self.retired += mine
            self.runs = [(n, r) for n, r in self.runs if n != level] + [(level + 1, self.spark.read.schema(every.schema).parquet(path))]
            level += 1


def repeated_windows(data: bytes, size: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the 13-word windows of pieces that a piece of an earlier document also holds.

    Windows of equal hash and length are compared byte by byte with the first of them; where one differs,
    all of that hash are told apart by their bytes.
    """
    hashes, starts, ends = [], [], []
    end = np.cumsum(size)
    x = 0
    while x < len(size):  # slabs of about 1 MB keep the tables of powers small
        y = int(np.searchsorted(end, end[x] - size[x] + (1 << 20), side="right"))
        y = max(y, x + 1)
        lo = int(end[x] - size[x])
        a = np.frombuffer(data, np.uint8, int(end[y - 1]) - lo, lo)
        at = end[x:y] - size[x:y] - lo
        gap = a == 32
        begin = np.zeros(len(a), bool)
        begin[1:] = gap[:-1]
        begin[at] = True
        stop = np.zeros(len(a) + 1, bool)
        stop[:-1] = gap
        stop[at + size[x:y]] = True
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
        words = count[x:y] + WINDOW - 1
        first = np.cumsum(words) - words
        w = np.repeat(first, count[x:y]) + np.arange(count[x:y].sum()) - np.repeat(np.cumsum(count[x:y]) - count[x:y], count[x:y])
        s, e = begin[w], stop[w + WINDOW - 1]
        hashes.append(span_hash(prefix_hash(a), s, e))
        starts.append(s + lo)
        ends.append(e + lo)
        x = y
    h, s, e, of = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.repeat(doc, count)
    length = e - s
    order = np.lexsort((of, length, h))
    a, c = h[order], length[order]
    group = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]) - 1
    first = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])][group]
    out = np.zeros(len(order), bool)
    out[order] = of[order] > of[first]
    odd = group[differs(data, s[order], s[first], c)]
    if len(odd):  # unlike windows of one hash
        seen: dict[bytes, int] = {}
        for i in order[np.isin(group, odd)].tolist():
            out[i] = of[i] > seen.setdefault(data[s[i] : e[i]], of[i])
    return out


def differs(data: bytes, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the pairs of spans (of 8 bytes or more) hold unlike bytes."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    out = np.zeros(len(left), bool)
    todo = np.flatnonzero(left != right)
    for i in todo[length[todo] > 4_096].tolist():
        out[i] = data[left[i] : left[i] + length[i]] != data[right[i] : right[i] + length[i]]
    todo = todo[length[todo] <= 4_096]
    for d in range(0, 4_096, 8):
        todo = todo[length[todo] > d]
        if not len(todo):
            break
        at = np.minimum(d, length[todo] - 8)
        same = eight[left[todo] + at] == eight[right[todo] + at]
        out[todo[~same]] = True
        todo = todo[same]
    return np.flatnonzero(out)


def digest_row(text: bytes | None, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = (text or b"").split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeats(docs: DataFrame, batches: int = 3, texts: bool = False, hot: int = anchors.HOT) -> DataFrame:
    """Remove every word covered by a 13-word window that also starts in a document of a smaller doc_id.

    docs has doc_id and text; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256 and,
    with texts, kept_text. Windows are judged on the input. Documents come in as `batches` batches by
    doc_id; each is merge-joined with the index of those before. A null text has no words; rows of a null
    doc_id are returned whole and remove nothing; rows of equal doc_id do not remove from each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, bits = anchors.measure(docs)
    index = FingerprintIndex(docs.sparkSession, max(16, total // 30 // BUCKET_ENTRIES), bits, hot=hot)
    bounds = docs.select(F.shiftright("doc_id", bits).alias("c")).agg(F.percentile_approx("c", [i / batches for i in range(1, batches)], F.lit(1000))).first()[0] or []
    edges = [None, *sorted({b << bits for b in bounds}), None]
    hits = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = docs if lo is None else docs.where(F.col("doc_id") >= lo)
        part = part if hi is None else part.where(F.col("doc_id") < hi)
        found = index.add(part)
        hits = found if hits is None else hits.unionByName(found)
    return cut_out(docs, docs, hits, total, bits, texts)


def add_batch(index: FingerprintIndex, history: DataFrame, batch: DataFrame, texts: bool = False) -> DataFrame:
    """Deduplicate a batch against all that the index holds, and index it: the rows of remove_repeats() for the batch.

    doc_ids of the batch follow those of the history, and start a new chunk. Of the history (the indexed
    documents), only the chunks that share a fingerprint with the batch are cut into pieces.
    """
    both = [d.select(F.col("doc_id").cast("long").alias("doc_id"), "text") for d in (history, batch)]
    hits = materialise(index.add(both[1]), "hits")
    total = anchors.measure(both[1])[0]
    return cut_out(both[0].unionByName(both[1]), both[1], hits, total, index.bits, texts)


def cut_out(docs: DataFrame, wanted: DataFrame, hits: DataFrame, total: int, bits: int, texts: bool) -> DataFrame:
    """Cut the repeated windows of docs out of the wanted ones of them."""
    buckets = max(16, total // BUCKET_BYTES)
    chunk = F.shiftright(F.col("doc_id"), bits)
    if wanted is not docs:
        docs = docs.join(hits.select(F.col("chunk").alias("_c")).distinct().hint("merge"), chunk == F.col("_c"), "left_semi")
    spans = anchors.judge(anchors.pieces(docs, hits, anchors.word_runs, buckets, within=False, bits=bits), repeated_windows, within=False)
    if wanted is not docs:
        spans = spans.join(wanted.select(chunk.alias("_c")).distinct().hint("merge"), F.col("chunk") == F.col("_c"), "left_semi")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts

    def rows(ids, bodies, by) -> pa.Table:
        out = [digest_row(t, anchors.covered(by.get(i), WINDOW)) for i, t in enumerate(bodies)]
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([n for n, _, _ in out], pa.int64()), "n_removed": pa.array([n for _, n, _ in out], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for _, _, k in out], pa.string())}
        if texts:
            cols["kept_text"] = pa.array([k.decode("utf-8", "replace") for _, _, k in out], pa.string())
        return pa.table(cols)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, bodies = anchors.in_order(left)
        return rows(ids, bodies, anchors.spans_of(right))

    def whole(parts):
        for b in parts:
            yield from rows(b.column("doc_id"), list(texts_of(b.column("text"))), {}).to_batches()

    done = anchors.chunked(wanted, bits).groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(apply, schema)
    return done.unionByName(wanted.where("doc_id is null").mapInArrow(whole, schema))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 13-word windows of all documents, removed: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
