"""Mixing sources to target weights: whole copies by rate, the rest by a hash-seeded draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import global_rank, materialise, n_words

# A table of sources of at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 16


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2
) -> DataFrame:
    """Targets of sources from (source, size) rows: (source, source_size, target).

    Sources by code point, null last, weigh `weights`, repeating, and share share[0]/share[1] of all
    sizes. A target stops at `most` times its source's size; the excess is shared again by weight until
    none is above. A source of size 0 has target 0. The level that settles this is found by aggregates
    over the table of sources alone; only scalars reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one leading character keeps null behind every text
    per = per.withColumn("_key", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")))
    per = global_rank(per, [], [F.col("_key").asc()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    per = materialise(per.select("source", "source_size", weight.alias("_w")), "sources")
    cap = F.col("source_size") * most
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    whole = total * share[0] / share[1]
    # the level only rises as sources reach their caps, so each round caps more of them or settles
    n, level = -1, None
    while True:
        over = F.lit(False) if level is None else cap <= F.col("_w") * level
        n_over, held, free = per.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))
        ).first()
        if n_over == n or free == 0:
            break
        n, level = n_over, (whole - held) / free
    over = F.lit(True) if level is None else cap <= F.col("_w") * level
    target = F.when(over, cap.cast("double")).otherwise(F.col("_w") * (level or 0.0))
    return per.select("source", "source_size", F.least(target, cap.cast("double")).alias("target"))


def draw(key: F.Column, seed: str) -> F.Column:
    """A number in [0, 1) fixed by the seed and the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32)


def with_copies(rows: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, source and others) with source_size, target and copies from the targets of sources.

    A short table of sources is broadcast, so rows are not shuffled; a longer one is joined in salted
    shuffles, so that a source of a third of all rows is not one task.
    """
    per = materialise(per, "targets")
    named = per.select(F.col("source").alias("_source"), "source_size", "target")
    if per.count() <= BROADCAST_SOURCES:
        out = rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source")), "left")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        many = named.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(many, (F.col("_salt") == F.col("_salt_")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = F.when(draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed) < rate - whole, 1).otherwise(0)
    return out.select(*rows.columns, "source_size", "target", (whole + extra).cast("long").alias("copies"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix:"
) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, copies.

    docs has doc_id, text, source; other columns are ignored. size is the number of words (null text: 0).
    The rate of a source is target / source_size; a document is emitted floor(rate) times plus once more
    when the draw fixed by its doc_id falls below the fraction. Rows of equal doc_id draw alike; a null
    doc_id draws as the text "null"; an empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return with_copies(sized, source_targets(sized.select("source", "size"), weights, share, most), seed)


def emit_copies(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix:"
) -> DataFrame:
    """The mixed corpus: each row of docs as often as mix() says, with the columns of docs, whatever their names."""
    per = source_targets(docs.select("source", n_words(F.col("text")).alias("size")), weights, share, most)
    rows = docs.select("doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = with_copies(rows, per, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("row.*")


def op9_mixing(spark, sf_dir) -> DataFrame:
    """Mix all documents: doc_id, size, source_size, target, taken (words taken, repeats counted)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# Sorted by the level at which a source reaches its cap, the capped sources are a prefix: the level that
# settles is the first whose remaining weight keeps the next source under its cap.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM per
), stepped AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 3 / 2 AS whole,
    coalesce(sum(2 * source_size) OVER o, 0)::DOUBLE AS held, (sum(w) OVER ()) - coalesce(sum(w) OVER o, 0) AS free,
    row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS step
  FROM weighed WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce(arg_min((whole - held) / free, step), 1e300) AS lv FROM stepped WHERE 2 * source_size > w * ((whole - held) / free)
), targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= w * lv THEN (2 * source_size)::DOUBLE ELSE w * lv END AS target FROM weighed, level
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
