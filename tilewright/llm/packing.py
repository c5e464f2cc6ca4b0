"""Packing: length buckets chosen by dynamic programming over the whole histogram, then token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import global_rank, materialise, n_words

def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (upper ends) of at most `buckets` buckets with the least padding; lengths are distinct and ascend.

    Padding of a bucket (i, j] is count * length_j - sum of lengths. For a fixed last bucket that is the
    least of lines in length_j, one for each i, so a lower hull of lines gives all j in one pass: O(buckets
    * n), in whole numbers. Of equal choices the one with the shorter boundary is taken.
    """
    n = len(lengths)
    lengths = [int(x) for x in lengths]
    c, s = [0], [0]
    for length, count in zip(lengths, counts, strict=True):
        c.append(c[-1] + int(count))
        s.append(s[-1] + int(count) * length)
    best: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        nxt: list[int | None] = [0] + [None] * n
        at = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i)
        top = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-c[j - 1], best[j - 1] + s[j - 1], j - 1)
                while len(hull) >= 2 and hides(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x, top = lengths[j - 1], min(top, len(hull) - 1)
            while top + 1 < len(hull) and hull[top + 1][0] * x + hull[top + 1][1] < hull[top][0] * x + hull[top][1]:
                top += 1
            nxt[j], at[j] = hull[top][0] * x + hull[top][1] + c[j] * x - s[j], hull[top][2]
        back.append(at)
        best = nxt
    ends, j = [], n
    for at in reversed(back):
        if j == 0:
            break
        ends.append(lengths[j - 1])
        j = at[j]
    return sorted(ends)


def hides(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def histogram(sized: DataFrame, length: str = "n_tokens") -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts) of the whole table, lengths over 0.

    D distinct lengths take D * D / 2 tokens at least, so at most sqrt(2 * tokens) rows reach the driver:
    6 million for 100 TB of text.
    """
    rows = sized.where(F.col(length) > 0).groupBy(length).count().toArrow()
    order = np.argsort(rows[length].to_numpy())
    return rows[length].to_numpy()[order], rows["count"].to_numpy()[order]


def pack(docs: DataFrame, buckets: int = 8, token_budget: int = 65_536) -> DataFrame:
    """Batches of documents: doc_id, n_tokens, bucket, padded_length, batch, position.

    docs has doc_id and text; other columns are ignored. n_tokens is the number of words. A document
    goes to the narrowest bucket that holds it; a bucket padded to length L forms batches of
    max(1, token_budget // L) documents in the order (doc_id, text digest), nulls first, so a padded
    batch stays within the budget unless a single document is longer than it. Documents without words
    need no batch: bucket, batch and position are null and padded_length is 0. Repeated rows are packed
    as often as they come. Batches are numbered from 0 within their bucket, positions from 0.
    """
    sized = docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("_tie"))
    sized = materialise(sized, "lengths")
    ends = best_boundaries(*histogram(sized), buckets)
    if not ends:
        null = F.lit(None).cast("long")
        return sized.select("doc_id", "n_tokens", F.lit(None).cast("int").alias("bucket"), F.lit(0).cast("long").alias("padded_length"), null.alias("batch"), null.alias("position"))
    bucket, width = F.lit(None).cast("int"), F.lit(0).cast("long")
    for k in range(len(ends) - 1, -1, -1):
        fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= ends[k])
        bucket = F.when(fits, F.lit(k)).otherwise(bucket)
        width = F.when(fits, F.lit(ends[k]).cast("long")).otherwise(width)
    placed = sized.select("doc_id", "n_tokens", "_tie", bucket.alias("bucket"), width.alias("padded_length"))
    ranked = global_rank(placed, ["bucket"], [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc_nulls_first(), F.col("n_tokens").asc()], "_rank")
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_length"), F.lit(1))))
    at = F.when(F.col("bucket").isNotNull(), F.col("_rank") - 1)
    return ranked.select("doc_id", "n_tokens", "bucket", "padded_length", F.floor(at / per).cast("long").alias("batch"), (at % per).cast("long").alias("position"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into 8 buckets and batches of 65,536 padded tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _layers(buckets: int) -> str:
    """The programme in SQL, a bucket at a time: the least padding up to each length, and the boundaries that give it."""
    out = ["d0 AS (SELECT 0::BIGINT AS k, 0::HUGEINT AS cost, []::BIGINT[] AS ends)"]
    for b in range(1, buckets + 1):
        out.append(
            f"d{b} AS (SELECT k, first(cost ORDER BY cost, past) AS cost, first(ends ORDER BY cost, past) AS ends FROM ("
            f"SELECT j.k, i.k AS past, p.cost + (j.c - i.c) * j.n - (j.s - i.s) AS cost, list_append(p.ends, j.n) AS ends FROM d{b - 1} p JOIN h i ON p.k = i.k JOIN h j ON i.k < j.k "
            f"UNION ALL SELECT 0, 0, 0, []) GROUP BY k)"
        )
    return ",\n".join(out)


# The order within a batch needs no tie-break where doc_ids are unlike, as in the given tables.
OP10_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents),
h AS MATERIALIZED (SELECT 0::BIGINT AS k, 0::BIGINT AS n, 0::HUGEINT AS c, 0::HUGEINT AS s UNION ALL
  SELECT row_number() OVER (ORDER BY n), n, sum(count(*)) OVER (ORDER BY n), sum(count(*) * n) OVER (ORDER BY n) FROM t WHERE n > 0 GROUP BY n),
{_layers(8)},
e AS (SELECT unnest(ends) AS width, unnest(range(len(ends))) AS bucket FROM d8 WHERE k = (SELECT max(k) FROM h)),
p AS (SELECT doc_id, n, (SELECT min(bucket) FROM e WHERE width >= n AND n > 0) AS bucket, coalesce((SELECT min(width) FROM e WHERE width >= n AND n > 0), 0) AS width FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST) - 1 AS spot, greatest(1, 65536 // greatest(width, 1)) AS per FROM p)
SELECT doc_id, n AS n_tokens, bucket::INTEGER AS bucket, width::BIGINT AS padded_length,
  CASE WHEN bucket IS NOT NULL THEN (spot // per)::BIGINT END AS batch, CASE WHEN bucket IS NOT NULL THEN (spot % per)::BIGINT END AS position FROM r
"""
