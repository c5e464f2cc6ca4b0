"""Tables of tiles in the order of their ids, with the zooms and bounds of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import addressing as A

# The edge of the map in degrees, and bounds in units of 1e-7 degrees.
MAX_LAT, E7 = 85.0511287798066, 1e7
METADATA = "min_zoom int, max_zoom int, min_lon_e7 int, min_lat_e7 int, max_lon_e7 int, max_lat_e7 int, center_zoom int, center_lon_e7 int, center_lat_e7 int"


def write(tiles: DataFrame, path: str, max_zoom: int | None = None, bounds: tuple[float, float, float, float] | None = None) -> None:
    """Write tiles (z, x, y, ...) by id under path/tiles, and one row of zooms and bounds under path/metadata.

    Without max_zoom it is the largest zoom of the table, 0 if that is empty; without bounds (west, south,
    east, north) they are those of the whole map. The metadata come last: a table without them is not whole.
    """
    t = tiles.withColumn("tile_id", A.hilbert_id(F.col("z"), F.col("x"), F.col("y")))
    t.repartitionByRange("tile_id").sortWithinPartitions("tile_id").write.partitionBy("z").parquet(f"{path}/tiles")
    west, south, east, north = bounds or (-180.0, -MAX_LAT, 180.0, MAX_LAT)
    e7 = [int(v * E7) for v in (west, south, east, north)] + [0] + [int((a + b) / 2 * E7) for a, b in ((west, east), (south, north))]
    names = [f.split()[0] for f in METADATA.split(", ")]
    deepest = F.lit(max_zoom) if max_zoom is not None else F.coalesce(F.max("z"), F.lit(0))
    zooms = tiles.sparkSession.read.schema(t.schema).parquet(f"{path}/tiles").agg(deepest.cast("int").alias("max_zoom"))
    zooms.select(F.lit(0).alias("min_zoom"), "max_zoom", *[F.lit(v).alias(n) for n, v in zip(names[2:], e7, strict=True)]).write.parquet(f"{path}/metadata")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """The tiles, and the one row of zooms and bounds."""
    return spark.read.parquet(f"{path}/tiles"), spark.read.schema(METADATA).parquet(f"{path}/metadata").first().asDict()
