"""Session helpers: table loading, and the shared folder for written intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{table}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it: one without a scheme is of the default file system."""
    jvm = spark.sparkContext._jvm
    plain = jvm.org.apache.hadoop.fs.Path(path)
    return plain.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(plain).toString()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder, since
    there the driver's disk is every task's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlake-"))
    return context.getCheckpointDir()


_given_out: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given_out.append(path)
    return path


def mark() -> int:
    """A point in time for ``release``."""
    return len(_given_out)


def release(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch tables given out since ``mark``, but for those in ``keep``.

    For callers that have read, or written elsewhere, whatever was made of them.
    """
    jvm = spark.sparkContext._jvm
    for path in _given_out[since:]:
        if path not in keep:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _given_out[since:] = [path for path in _given_out[since:] if path in keep]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
