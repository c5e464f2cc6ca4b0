"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tilewright.llm.common import materialise
from tilewright.llm.hashing import mix64, prefix_hash, span_hash, texts_of

DIM_BITS = 22
SCORE = "_toxicity_score"
# Bytes of words: ASCII letters and digits and every byte above 127; all else separates words.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def features(text: bytes | None) -> np.ndarray:
    """Distinct hashed features of a whole text: words, pairs of neighbours and pairs with one word between."""
    low = (text or b"").decode("utf-8", "replace").lower().encode()
    if not low:
        return np.zeros(0, np.int64)
    a = np.frombuffer(low, np.uint8)
    edge = np.diff(np.concatenate([[False], _WORD_BYTE[a], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w = span_hash(prefix_hash(a), start, end)
    pair, skip = mix64(w[:-1] * np.uint64(3) + w[1:]), mix64(w[:-2] * np.uint64(5) + w[2:] + np.uint64(7))
    return (np.concatenate([w, pair, skip]) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; L1 keeps most weights at exactly 0."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << DIM_BITS) + 1, np.float32), np.zeros((1 << DIM_BITS) + 1, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << DIM_BITS, 0.0, self.l1)  # the bias is not shrunk
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, at: np.ndarray, y: int, importance: float = 1.0) -> None:
        w = self.weights(at)
        g = importance * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 8_000, epochs: int = 4, least_docs: int = 3, importance: float = 5.0, max_bytes: int = 512 << 20) -> dict[str, np.ndarray]:
    """Sparse weights {"at", "w"} from the labelled documents.

    labels has doc_id and toxic (rows with a null in either are left out). The documents of at most max_per_class
    labels of each class, those of the smallest hash of doc_id, are learnt from; equal rows are one row, and of
    all these rows at most 2 * max_per_class are taken, in the order of their hashes, as long as they have max_bytes of
    features (four bytes each) in all: the documented bounds on what is broadcast and on the one task that learns. Without labels of both classes all weights are 0. Features in fewer than least_docs of them are left out;
    toxic rows count `importance` times.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = None
    for y in (0, 1):
        mine = usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_per_class)
        picked = mine if picked is None else picked.union(mine)
    picked = materialise(picked, "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.unique(features(t)).astype(np.uint32).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(blobs, pa.binary())], ["doc_id", "y", "at"])

    # equal rows are one; of unlike rows under one doc_id, as many as of doc_ids at most
    data = rows.mapInArrow(featurise, "doc_id long, y int, at binary").distinct()
    data = materialise(data.withColumn("row", F.xxhash64("doc_id", "y", "at")), "features")
    sizes = data.select("row", F.octet_length("at").alias("_n")).distinct().orderBy("row", "_n").limit(2 * max_per_class)
    taken = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("row", "_n"))
    within = sizes.withColumn("_taken", taken).where(F.col("_taken") <= max_bytes)
    if within.count() < data.count():
        data = data.join(F.broadcast(within.select(F.col("row").alias("_row"), "_n")), (F.col("row") == F.col("_row")) & (F.octet_length("at") == F.col("_n")), "left_semi")
    data = data.select("doc_id", "y", "at")

    def learn(table: pa.Table) -> pa.Table:
        model = Ftrl()
        y, at = table["y"].to_numpy(), table["at"].to_pylist()
        seen = np.zeros(1 << DIM_BITS, np.int32)
        for x in at:
            seen[np.frombuffer(x, np.uint32)] += 1
        for epoch in range(epochs):
            order = np.argsort(mix64(table["doc_id"].to_numpy().astype(np.uint64) + np.uint64(epoch)), kind="stable")
            for i in order:
                x = np.frombuffer(at[i], np.uint32).astype(np.int64)
                model.step(np.append(x[seen[x] >= least_docs], 1 << DIM_BITS), int(y[i]), importance if y[i] else 1.0)
        used = np.flatnonzero(model.n)
        w = model.weights(used)
        keep = (w != 0) | (used == 1 << DIM_BITS)
        return pa.table({"at": pa.array(used[keep], pa.int64()), "w": pa.array(w[keep].astype(np.float64))})

    found = data.groupBy(F.lit(1).alias("all")).applyInArrow(learn, "at long, w double").toArrow()
    at, w = found["at"].to_numpy(), found["w"].to_numpy()
    order = np.argsort(at)
    return {"at": at[order], "w": w[order]}


def score(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and SCORE, 0 to 1, from the whole text (null and empty: the bias alone).

    The sparse weights are broadcast (2^22 at most). A column named SCORE cannot be kept.
    """
    if SCORE in keep:
        raise ValueError(f"{SCORE} is a column of the result")
    return score_rows(docs, model, keep).select("row.*", SCORE)


def score_rows(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """row, a struct of the columns `keep` of docs, whatever their names, and SCORE."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["text"].alias("text"))
    out = StructType([rows.schema["row"], StructField(SCORE, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << DIM_BITS) + 1)
        dense[shared.value["at"]] = shared.value["w"]
        for batch in batches:
            scores = []
            for text in texts_of(batch.column("text")):
                at = features(text)
                at = np.unique(at[dense[at] != 0])
                scores.append(1.0 / (1.0 + np.exp(-np.clip(dense[at].sum() + dense[1 << DIM_BITS], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", SCORE])

    return rows.mapInArrow(run, out)


def held_out() -> F.Column:
    """True for the documents of the fold that is never learnt from; a null doc_id belongs to no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_fold(docs: DataFrame, labels: DataFrame, **how) -> dict[str, np.ndarray]:
    return train(docs, labels.where(~held_out()), **how)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents: doc_id, held_out, score, predicted (score >= 0.7). Null and empty texts get the bias alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_on_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.7).cast("int").alias("predicted"))
