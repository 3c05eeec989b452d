"""Change capture events as a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHANGE_EVENT_JSON
from . import changelog


def parse_changes(raw: DataFrame, value: str = "value", excluded: Sequence[str] = ()) -> DataFrame:
    """Change events from JSON text, without those of excluded databases. A log's number and offset stay with them."""
    place = [c for c in ("log_number", "log_offset") if c in raw.columns]
    event = raw.select(*place, F.from_json(F.col(value).cast("string"), CHANGE_EVENT_JSON).alias("e")).select(*place, "e.*")
    return event.where(~F.col("database").isin(*excluded)) if excluded else event


def read_change_stream(
    spark: SparkSession,
    options: Mapping[str, str],
    excluded: Sequence[str] = (),
    fmt: str = "kafka",
) -> DataFrame:
    """Stream of change events: from Kafka, from text files (``fmt="text"``), or from numbered logs (``fmt="fleet_changelog"``).

    Kafka keeps the order within a partition; consumers order by position, not by arrival.
    """
    if fmt == changelog.FORMAT:
        spark.dataSource.register(changelog.LogSource)
    return parse_changes(spark.readStream.format(fmt).options(**options).load(), "value", excluded)
