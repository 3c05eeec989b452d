"""Row counts and column ranges from the footers of Parquet files: no data page is read.

Defined cases: a file without rows or row groups counts nothing; a column without statistics, or one that a
file lacks, has an unknown range, so all its rows may or may not match; nulls match no range. NaN is no part of
statistics: in a floating column it counts as a value inside its row group's range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import qualified
from .records import _file_system

_GROUP = "path string, row_group int, rows bigint, bytes bigint, `column` string, nulls bigint, low double, high double"


def _footers(columns: Sequence[str]):
    def read(batches):
        import datetime
        import decimal

        import pyarrow as pa
        import pyarrow.parquet as pq

        def number(value):
            if isinstance(value, datetime.datetime):
                stamp = value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
                return stamp.timestamp()
            if isinstance(value, datetime.date):
                return float((value - datetime.date(1970, 1, 1)).days)
            return float(value) if isinstance(value, (bool, int, float, decimal.Decimal)) else None

        shape = pa.schema([
            ("path", pa.string()), ("row_group", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64()),
            ("column", pa.string()), ("nulls", pa.int64()), ("low", pa.float64()), ("high", pa.float64()),
        ])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, plain = _file_system(path)
                with system.open_input_file(plain) as handle:
                    meta = pq.ParquetFile(handle).metadata
                places = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                found = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for column in columns or [None]:
                        place = places.get(column)
                        stats = group.column(place).statistics if place is not None else None
                        ranged = stats is not None and stats.has_min_max
                        found.append({
                            "path": path, "row_group": g, "rows": group.num_rows, "bytes": group.total_byte_size,
                            "column": column,
                            "nulls": stats.null_count if stats is not None and stats.has_null_count else None,
                            "low": number(stats.min) if ranged else None, "high": number(stats.max) if ranged else None,
                        })
                yield pa.RecordBatch.from_pylist(found, schema=shape)

    return read


def footers(spark: SparkSession, path: str, columns: Sequence[str] = (), tasks: int = 64) -> DataFrame:
    """(path, row_group, rows, bytes, column, nulls, low, high): a row per row group and asked column.

    Low and high are numbers: days of a date, seconds of a timestamp (one without a zone as UTC), null for
    texts. Files are listed by Spark and their footers read by tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(qualified(spark, path))
    return files.where("length > 0").select("path").repartition(tasks).mapInArrow(_footers(list(columns)), _GROUP)


def table_rows(groups: DataFrame) -> DataFrame:
    """(rows, bytes, files) of the table, exact."""
    each = groups.dropDuplicates(["path", "row_group"])
    return each.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.countDistinct("path").alias("files"),
    )


def column_ranges(groups: DataFrame) -> DataFrame:
    """(column, rows, nulls, low, high) per asked column; unknown parts make the whole unknown."""
    def known(value, whole):
        return F.when(F.count_if(F.col(value).isNull() & (F.col("rows") > F.coalesce("nulls", F.lit(0)))) == 0, whole)

    return groups.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.when(F.count("nulls") == F.count(F.lit(1)), F.sum("nulls")).alias("nulls"),
        known("low", F.min("low")).alias("low"), known("high", F.max("high")).alias("high"),
    )


def rows_between(groups: DataFrame, low: float, high: float) -> DataFrame:
    """(column, at_least, estimate, at_most): rows with ``low <= value <= high``, by each asked column.

    A row group that lies inside counts whole and one outside not at all; of one that the range cuts, the
    estimate takes the share of its span that lies inside, as if its values were spread evenly. The bounds
    differ by the rows of the groups that are cut, whatever the values are.
    """
    filled = F.col("rows") - F.coalesce("nulls", F.lit(0))
    ranged = F.col("low").isNotNull() & F.col("high").isNotNull()
    inside = ranged & F.col("nulls").isNotNull() & (F.col("low") >= low) & (F.col("high") <= high)
    outside = (ranged & ((F.col("high") < low) | (F.col("low") > high))) | (filled == 0)
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    share = F.when(ranged, (F.least("high", F.lit(float(high))) - F.greatest("low", F.lit(float(low)))) / span).otherwise(0.5)
    return groups.groupBy("column").agg(
        F.sum(F.when(outside, 0).when(inside, filled).otherwise(0)).alias("at_least"),
        F.round(F.sum(F.when(outside, 0.0).when(inside, filled.cast("double")).otherwise(share * filled))).cast("long").alias("estimate"),
        F.sum(F.when(outside, 0).otherwise(filled)).alias("at_most"),
    )
