"""Metric lines of the fleet: all collectors' output in one format."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import with_topology


def as_metrics(
    rows: DataFrame,
    metric: Column,
    value: Column,
    tags: Sequence[str] = (),
    keep: Sequence[str] = ("host", "port"),
    optional: Sequence[str] = (),
) -> DataFrame:
    """(host, port, metric, value, tags) from a collector's output; a tag in ``optional`` is left out where it is null or empty."""
    pairs = [x for t in (*tags, *optional) for x in (F.lit(t), F.col(t).cast("string"))]
    tag_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    if optional:
        tag_map = F.map_filter(tag_map, lambda k, v: ~k.isin(*optional) | (F.coalesce(v, F.lit("")) != ""))
    return rows.select(*keep, metric.alias("metric"), value.cast("string").alias("value"), tag_map.alias("tags"))


def rollup(parts: Sequence[DataFrame], config: DataFrame, epoch: int) -> DataFrame:
    """All collectors' metrics with the instance's replica set and role; ``undef`` where unknown."""
    together = reduce(lambda a, b: a.unionByName(b), parts)
    known = with_topology(together, config)
    return known.select(
        "metric",
        F.lit(epoch).alias("epoch"),
        "value",
        F.coalesce("replica_set", F.lit("undef")).alias("replica_set"),
        F.coalesce("role", F.lit("undef")).alias("db_type"),
        "tags",
    )
