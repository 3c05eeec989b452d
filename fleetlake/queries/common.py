"""Shared pieces of the registered queries: derived inputs and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_NOW = "TIMESTAMP '2001-08-02 00:00:00'"


def cents(col: str) -> Column:
    """A two-decimal amount as whole hundredths, so that sums are exact."""
    return F.round(F.col(col) * 100).cast("long")


def sql_cents(col: str) -> str:
    return f"CAST(round({col} * 100) AS BIGINT)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the number in ``props`` as ``k`` and the value in hundredths as ``amount``."""
    return load(spark, d, "events").withColumns(
        {"k": F.get_json_object("props", "$.k").cast("long"), "amount": cents("value")}
    )


SQL_EVENTS = (
    "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    f"{sql_cents('value')} AS amount FROM events"
)
