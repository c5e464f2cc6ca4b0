"""Helpers shared by the training-data operators: shared scratch tables, global ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A word is a maximal run of characters other than space and the five ASCII control separators.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a local session may leave it unset, and gets one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by materialise()."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, by: list[str], order: list[F.Column], name: str) -> DataFrame:
    """Number rows from 1 within each group of the columns `by`, in the given order, without a group per task.

    Rows are dealt by range over (by, order), so that a large group spans many tasks; ranks inside a
    task are moved on by the number of rows that earlier tasks hold of the same group. That table has a
    row for each task and group in it: at most tasks + groups rows.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], *order)
    dealt = materialise(dealt.withColumn("_part", F.spark_partition_id()), "rank")
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)))
    sizes = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not by:
        before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    keys = ["_part", *by]
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(starts[c]) for c in keys])
    out = local.join(starts, same).select(*[local[c] for c in df.columns], (local["_at"] + starts["_before"]).cast("long").alias(name))
    return out


def min_label(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) for each id that has an edge.

    Alternates large-star and small-star rounds (each hangs the neighbours of a vertex on its smallest
    one) until the edges stay as they are; component is the smallest id that can be reached. Each round
    is written to the shared folder. The rounds grow as the square of the logarithm of the edges.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = materialise(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(stats):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).groupBy("id").agg(F.min("component").alias("component"))
        mark = tuple(stats)
        sym = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "edges")
        drop_scratch(now)
        now = after


def join_spread(rows: DataFrame, table: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows left-joined to table (key, values, copies: the rows that hold the key), however many rows share a key.

    Keys that more than max(1,000, total / 10,000) rows hold are 10,000 at most: they are broadcast, so
    their rows stay where they are. All others are joined by shuffle at every size.
    """
    values = [c for c in table.columns if c not in (*key, "copies")]
    crowd = table.where(F.col("copies") > max(1_000, total // 10_000))
    crowd = crowd.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_crowd"))
    met = rows.join(F.broadcast(crowd), key, "left")
    near = met.where("_crowd").select(*rows.columns, *[F.col(f"_{v}").alias(v) for v in values])
    rest = met.where("_crowd is null").select(*rows.columns).join(table.drop("copies").hint("merge"), key, "left")
    return near.unionByName(rest.select(near.columns))
