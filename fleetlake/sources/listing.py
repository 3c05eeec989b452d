"""Object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: backups at or below this size are not usable.
MIN_BACKUP_BYTES = 1024 * 1024


def read_listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size, modified) of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def _name(path: str):
    return F.substring_index(F.col(path), "/", -1)


def valid_backups(listing: DataFrame, min_bytes: int = MIN_BACKUP_BYTES) -> DataFrame:
    """Objects large enough to be a backup."""
    return listing.where(F.col("size") > min_bytes)


def valid_exports(listing: DataFrame) -> DataFrame:
    """Non-empty objects."""
    return listing.where(F.col("size") > 0)


def garbage_objects(listing: DataFrame, path: str = "path") -> DataFrame:
    """Empty objects that are not markers (markers begin with an underscore)."""
    return listing.where((F.col("size") == 0) & ~_name(path).startswith("_"))
