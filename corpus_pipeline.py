"""A corpus pipeline of five stages over the documents table, each stage one of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialise
from tilewright.llm.mixing import emit_copies
from tilewright.llm.near_texts import judged
from tilewright.llm.packing import pack
from tilewright.llm.secrets import redact
from tilewright.llm.toxicity import SCORE, score_rows, train_on_fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7. Labels are learnt from the fold of op8."""
    model = train_on_fold(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_rows(docs, model, docs.columns).where(F.col(SCORE) < 0.7).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest doc_id; the least row of equal ones.

    Unlike rows of a doc_id are judged apart. Rows of a null doc_id belong to no component and stay.
    """
    key = ["doc_id", "th"]
    kept = judged(docs).where("kept and doc_id is not null").groupBy(key).agg(F.count("*").alias("n"))
    kept = materialise(kept, "kept").hint("merge")  # grows with the corpus: never broadcast
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"))
    out = rows.join(kept, key, "left_semi")
    if not kept.where("n > 1").isEmpty():
        # of rows equal in both and unlike in other columns the least one stays, so that reruns agree
        least = rows.join(kept.where("n > 1"), key, "left_semi").groupBy(key).agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = rows.join(kept.where("n = 1"), key, "left_semi").unionByName(least.select(rows.columns))
    return out.unionByName(rows.where("doc_id is null")).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span of the text replaced by a mark."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate asks for."""
    return emit_copies(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of the mixed corpus; a row for each copy."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: SQL cannot express the classifier; tests/llm/test_pipeline.py holds run() against a plain version, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over sf_dir's documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
