"""Releases: manifest audits, zoom agreement, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fields of a manifest.
SCHEMA = "schema_version int, version string, url string, sha256 string, size long, min_zoom int, max_zoom int, tile_schema string, created_at string"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def scan_manifests(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Manifests from JSON texts: the fields, and decoded: valid JSON without unknown fields."""
    known = F.array(*[F.lit(f) for f in FIELDS])
    keys = F.json_object_keys(column)
    ok = keys.isNotNull() & (F.size(F.array_except(keys, known)) == 0)
    out = lines.withColumn("m", F.from_json(column, SCHEMA)).withColumn("decoded", F.coalesce(ok, F.lit(False)))
    return out.select(*[c for c in lines.columns if c != column], "decoded", "m.*")


def audit(manifests: DataFrame) -> DataFrame:
    """reason: the first rule that a manifest breaks, null if none."""
    m = F.col
    url = (m("url").startswith("https://") & (F.length("url") > 8)) | m("url").startswith("local:")
    checks = [
        ("decode", ~m("decoded")), ("schema", F.coalesce(m("schema_version"), F.lit(0)) != 1), ("version", F.coalesce(m("version"), F.lit("")) == ""), ("url", ~F.coalesce(url, F.lit(False))),
        ("sha256", ~F.coalesce(m("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))), ("size", F.coalesce(m("size"), F.lit(0)) <= 0),
        ("zoom", (F.coalesce(m("min_zoom"), F.lit(0)) < 0) | (F.coalesce(m("max_zoom"), F.lit(0)) < F.coalesce(m("min_zoom"), F.lit(0))) | (F.coalesce(m("max_zoom"), F.lit(0)) > 24)),
        ("tile_schema", F.coalesce(m("tile_schema"), F.lit("")) == ""), ("created_at", ~F.coalesce(m("created_at").rlike(RFC3339), F.lit(False)) | F.try_to_timestamp("created_at").isNull()),
    ]
    reason = F.lit(None).cast("string")
    for name, broken in reversed(checks):
        reason = F.when(broken, name).otherwise(reason)
    return manifests.withColumn("reason", reason)


def zoom_agreement(archives: DataFrame, manifests: DataFrame) -> DataFrame:
    """archives (version, a_min, a_max, a_schema) against the manifest of the same version."""
    both = archives.join(manifests.select("version", "min_zoom", "max_zoom", "tile_schema"), "version")
    agrees = (F.col("a_min") == F.col("min_zoom")) & (F.col("a_max") == F.col("max_zoom")) & (F.col("a_schema") == F.col("tile_schema"))
    return both.withColumn("agrees", agrees)


def serving_eligible(manifests: DataFrame) -> DataFrame:
    out = manifests.withColumn("planet", (F.col("min_zoom") == 0) & (F.col("max_zoom") == 14))
    return out.withColumn("terrain", F.col("max_zoom") <= 12)


def retention(releases: DataFrame, keep: int) -> DataFrame:
    """The releases (dataset, version, mtime, active) that stay: the newest N of each dataset and the active one.

    The filter on the rank lets each task keep N rows of a dataset before the shuffle.
    """
    newest = Window.partitionBy("dataset").orderBy(F.desc("mtime"), F.desc("version"))
    top = releases.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= max(1, keep)).drop("_k")
    return top.unionByName(releases.where("active").join(top.select("dataset", "version"), ["dataset", "version"], "left_anti").select(*releases.columns))


def content_type(kind):
    """Media type of the tiles of a raster archive, by the type in its header."""
    return F.when(kind == "png", "image/png").otherwise("image/webp")
