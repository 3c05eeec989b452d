"""Percentiles from latency histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the percentiles that are reported.
PERCENTILES = (50.0, 90.0, 95.0, 99.0, 99.9, 99.9999)


def histogram_percentile(
    histogram: DataFrame, keys: Sequence[str], percentiles: Sequence[float] = PERCENTILES
) -> DataFrame:
    """(keys, percentile, value): mean of the bucket that holds the percentile, times 1000.

    The bucket is the first whose cumulative count reaches the share of all points; a bucket
    without points gives no row. A histogram has one row per bucket, few per key, so its
    window is small whatever the data behind it.
    """
    so_far = Window.partitionBy(*keys).orderBy("bucket")
    running = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = histogram.select(
        *keys,
        "bucket",
        "count",
        "total",
        F.sum("count").over(running).alias("cumulative"),
        F.sum("count").over(everything).alias("points"),
    )
    asked = F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))
    reached = counted.withColumn("percentile", asked).where(F.col("cumulative") >= F.col("points") * F.col("percentile") * F.lit(0.01))
    holder = reached.groupBy(*keys, "percentile").agg(
        F.min_by(F.struct("total", "count"), "bucket").alias("b")
    )
    value = F.try_divide(F.col("b.total"), F.col("b.count")) * 1000
    return holder.select(*keys, "percentile", value.alias("value")).where("value IS NOT NULL")
