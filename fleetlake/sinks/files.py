"""Text sinks, success markers and all-or-nothing writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mining import freqs_descending
from ..session import qualified
from ..sources.records import _file_system


def format_metrics(metrics: DataFrame) -> DataFrame:
    """(value): one ``mysql.{metric} {epoch} {value} replica_set=… db_type=… k=v …`` line per row.

    Rows have metric, epoch, value, replica_set, db_type and a map of further tags.
    """
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    text = F.concat(
        F.lit("mysql."), "metric", F.lit(" "), F.col("epoch").cast("string"), F.lit(" "), F.col("value").cast("string"),
        F.lit(" replica_set="), "replica_set", F.lit(" db_type="), "db_type", F.lit(" "), tags,
    )
    return metrics.select(F.trim(text).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Write metric lines as text."""
    format_metrics(metrics).write.mode("append").text(path)


def write_freqs(freqs: DataFrame, path: str) -> None:
    """Substring frequencies as JSON lines, most frequent first across the files in name order."""
    freqs_descending(freqs).select("substr", "freq").write.mode("overwrite").json(path)


def _apply_markers(partition) -> None:
    from pyarrow import fs

    for row in partition:
        system, path = _file_system(row["path"])
        if row["action"] == "create":
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(b" ")
        elif system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_file(path)


def write_success_markers(actions: DataFrame, root: str, keys: Sequence[str]) -> None:
    """Create or remove a ``_SUCCESS`` marker per row of (keys, action), from the tasks."""
    folders = [F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys]
    jvm = actions.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(actions.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    marked = actions.where(F.col("action").isin("create", "remove"))
    path = F.concat_ws("/", F.lit(qualified(actions.sparkSession, root).rstrip("/")), *folders, F.lit("_SUCCESS"))
    marked.select(path.alias("path"), "action").foreachPartition(_apply_markers)


def atomic_write(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> None:
    """Write to staging beside the target, run the check on what was written, and only then give it its name.

    ``check`` returns the rows that are wrong; any such row leaves ``path`` untouched.
    """
    spark = df.sparkSession
    parent, _, name = path.rstrip("/").rpartition("/")
    staging = f"{parent or '.'}/.{name}-staging-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staging)
    wrong = check(spark.read.format(fmt).schema(df.schema).load(staging))
    if not wrong.isEmpty():
        raise ValueError(f"check failed, {path} was not written; staged data is in {staging}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    system.mkdirs(target.getParent())
    if not system.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not rename {staging} to {path}")
