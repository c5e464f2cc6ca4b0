"""Sources that are read with a fixed shape: lines of text, and the log of requests as they arrive, whole or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed shape of the request log: as requests arrive. body_length is that of the header, -1 for a body of unknown length.
REQUESTS = "event_id long, ms long, peer string, method string, target string, body_length long"


def names(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    """One name a line, trimmed; blank lines are left out."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias(column)).where(F.col(column) != "")


def texts(spark: SparkSession, path: str, column: str = "raw") -> DataFrame:
    """One text a line, as it is."""
    return spark.read.text(path).withColumnRenamed("value", column)


def request_log(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Requests of Parquet files, as a table or as a stream of micro-batches."""
    if stream:
        return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.read.schema(REQUESTS).parquet(path)
