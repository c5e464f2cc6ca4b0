"""Size reports of stages and layers."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stage_report(entries: DataFrame, stages: tuple[str, ...] = ("stage_zoom", "part")) -> DataFrame:
    """Per stage: tiles, non_empty, wire_bytes, bytes (inflated), median, p90 (the value at place int(0.9 n)), largest.

    entries are those of streams (stages, payload inflated, wire: the framed length, at the first entry of a stage).
    """
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    sized = entries.select(*stages, "wire", size.alias("b"))
    full = F.when(F.col("b") > 0, F.col("b"))
    out = sized.groupBy(*stages).agg(
        F.count("*").alias("tiles"), F.count(full).alias("non_empty"), F.sum("wire").alias("wire_bytes"), F.sum("b").alias("bytes"),
        F.coalesce(F.median(full), F.lit(0.0)).alias("median"), F.max("b").cast("long").alias("largest"),
    )
    # the value at a place: sizes are counted first, so a stage is as many rows as it has different sizes
    counts = sized.where("b > 0").groupBy(*stages, "b").count()
    w = Window.partitionBy(*stages)
    placed = counts.withColumn("upto", F.sum("count").over(w.orderBy("b"))).withColumn("n", F.sum("count").over(w))
    p90 = placed.where(F.col("upto") > F.floor(F.col("n") * 0.9)).groupBy(*stages).agg(F.min("b").cast("long").alias("p90"))
    return out.join(p90, list(stages), "left").withColumn("p90", F.coalesce("p90", F.lit(0).cast("long")))


def layer_report(layers: DataFrame, stage: str = "z") -> DataFrame:
    """Per stage and layer: bytes and share of the stage."""
    out = layers.groupBy(stage, "layer").agg(F.sum("bytes").alias("bytes"))
    return out.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy(stage)), 9))


def layer_rank(layers: DataFrame, stage: str = "z") -> DataFrame:
    out = layers.groupBy(stage, "layer").agg(F.sum("bytes").alias("bytes"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(stage).orderBy(F.desc("bytes"), "layer")))


def compression_report(entries: DataFrame, stages: tuple[str, ...] = ("stage_zoom",), level: int = 6) -> DataFrame:
    """Per stage: inflated bytes, the sum of single-tile deflate sizes, and the bytes of whole stages on the wire."""

    def run(batches):
        for b in batches:
            tiles = b.column("payload").to_pylist()
            sizes = [pa.array([len(p or b"") for p in tiles], pa.int64()), pa.array([len(zlib.compress(p, level)) if p else 0 for p in tiles], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(s) for s in stages], b.column("wire"), *sizes], [*stages, "wire", "raw", "packed"])

    types = dict(entries.dtypes)
    sized = entries.select(*stages, "wire", "payload").mapInArrow(run, ", ".join(f"{s} {types[s]}" for s in stages) + ", wire long, raw long, packed long")
    return sized.groupBy(*stages).agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("deflate_bytes"), F.sum("wire").alias("wire_bytes"))
