"""Land cover: counts, rules, merging of low zooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_tiles(exploded: DataFrame) -> DataFrame:
    """Features (z, x, y, class, subclass, source, points, pixels) of rows of bundles.explode_features(), points and size from their geometry.

    Rows with an error are left out; a feature without a source is the map's ("osm").
    """
    value = lambda k: F.try_element_at("attributes", F.lit(k))
    return exploded.where("error is null").select("z", "x", "y", value("class").alias("class"), value("subclass").alias("subclass"), F.coalesce(value("source"), F.lit("osm")).alias("source"), "points", "pixels")


def counts(features: DataFrame) -> DataFrame:
    return features.groupBy("z", "x", "y", F.coalesce("class", F.lit("")).alias("class")).agg(F.count("*").alias("features"))


def rules(features: DataFrame) -> DataFrame:
    """Per class: whether it breaks "none at zoom 4" or "some at zoom 6 and 7"; zoom 5 is only reported."""
    at = lambda z: F.count(F.when(F.col("z") == z, 1))
    out = features.groupBy(F.coalesce("class", F.lit("")).alias("class")).agg(*[at(z).alias(f"z{z}") for z in (4, 5, 6, 7)])
    return out.withColumn("fails", (F.col("z4") > 0).cast("int") + (F.col("z6") == 0).cast("int") + (F.col("z7") == 0).cast("int"))


def eligible_zooms(features: DataFrame, deepest: int = 14) -> DataFrame:
    """A row for each zoom of a feature: features of the map source ("osm") from zoom 5 on, others from their own minzoom."""
    first = F.when(F.col("source") == "osm", F.lit(5)).otherwise(F.col("minzoom"))
    return features.where(first <= deepest).withColumn("zoom", F.explode(F.sequence(first, F.lit(deepest))))


def merge(features: DataFrame) -> DataFrame:
    """Features (z, x, y, class, subclass, source, points, pixels) of a tile with equal attributes as one: parts, pixels.

    Features of the map source with a subclass merge at zooms 5 to 7; at 8 and 9 only woods, apart by
    whether they have 300 points; from 10 to 13 only woods of fewer. Map features smaller than the zoom's
    limit are dropped: 2 pixels up to zoom 9, 4 at 10, 8 up to 13. All others stay as they are.
    """
    z, wood, few = F.col("z"), F.col("subclass").isin("wood", "forest"), F.col("points") < 300
    mine = F.col("source") == "osm"
    limit = F.when(z <= 9, 2).when(z == 10, 4).when(z <= 13, 8).otherwise(0)
    by = F.when(z.between(5, 7), "all").when(z.between(8, 9) & wood, F.when(few, "<300").otherwise(">300")).when(z.between(10, 13) & wood & few, "<300")
    kept = features.where(~mine | (F.col("pixels") >= limit)).withColumn("_g", F.when(mine & F.col("subclass").isNotNull(), by))
    attributes = ("z", "x", "y", "class", "subclass")
    merged = kept.where("_g is not null").groupBy(*attributes, "_g").agg(F.count("*").alias("parts"), F.sum("pixels").cast("long").alias("pixels")).drop("_g")
    return merged.unionByName(kept.where("_g is null").select(*attributes, F.lit(1).cast("long").alias("parts"), F.col("pixels").cast("long").alias("pixels")))


def probe(features: DataFrame, points: DataFrame) -> DataFrame:
    """points (id, z, x, y) with the counts of their tile; without land cover the count is 0."""
    return points.join(counts(features), ["z", "x", "y"], "left").select("id", "z", "x", "y", "class", F.coalesce("features", F.lit(0).cast("long")).alias("features"))
