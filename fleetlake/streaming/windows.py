"""Windowed streams: freshness, rates, leases, late rows.

Streams take a TIMESTAMP event time (timestamps without zone cannot carry a watermark) and
state what they wait for as a watermark. Rows later than it are dropped, and counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lag import LOOSE_HEARTBEAT_LAG, NORMAL_HEARTBEAT_LAG
from ..operators.lifecycle import LEASE_SECONDS


def event_time(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """The stream with its time as TIMESTAMP under a watermark. Times without zone are UTC."""
    timed = df
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        timed = df.withColumn(ts, F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts))))
    return timed.withWatermark(ts, watermark)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def local_time(col: str) -> Column:
    """A TIMESTAMP as a timestamp without zone, in UTC."""
    seconds = F.unix_micros(col).cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def heartbeat_lag_stream(stream: DataFrame, server: str, ts: str, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(server, start, heartbeat, seconds, alert) per window: how stale a server was at its end."""
    seen = event_time(stream, ts, watermark).groupBy(F.window(ts, window).alias("w"), server).agg(F.max(ts).alias("heartbeat"))
    stale = F.col("w.end").cast("long") - F.col("heartbeat").cast("long")
    alert = F.when(stale > LOOSE_HEARTBEAT_LAG, "loose").when(stale > NORMAL_HEARTBEAT_LAG, "normal").otherwise("ok")
    return seen.select(
        server, local_time("w.start").alias("start"), local_time("heartbeat").alias("heartbeat"),
        stale.alias("seconds"), alert.alias("alert"),
    )


def metric_windows(
    stream: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column], seconds: int, watermark: str
) -> DataFrame:
    """Sums and whole per-second rates of counters per tumbling window."""
    return _windowed(stream, keys, ts, values, seconds, seconds, watermark)


def rolling_rates(
    stream: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column], seconds: int, step: int, watermark: str
) -> DataFrame:
    """The same over a sliding window that moves by ``step`` seconds."""
    return _windowed(stream, keys, ts, values, seconds, step, watermark)


def _windowed(stream, keys, ts, values, seconds, step, watermark):
    window = F.window(ts, f"{seconds} seconds", f"{step} seconds").alias("w")
    sums = [F.sum(v).cast("long").alias(n) for n, v in values.items()]
    grouped = event_time(stream, ts, watermark).groupBy(window, *keys).agg(*sums)
    rates = [F.call_function("div", F.col(n), F.lit(seconds)).alias(f"{n}_rate") for n in values]
    return grouped.select(*keys, local_time("w.start").alias("start"), *values, *rates)


def lease_sessions_stream(stream: DataFrame, keys: Sequence[str], ts: str, seconds: int = LEASE_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """(keys, lease_start, expires, n_events): leases as session windows over take and extend events.

    For busy keys set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``: sessions
    are then merged inside each input partition first, and shuffled as sessions, not as events.
    """
    session = F.session_window(ts, f"{seconds} seconds").alias("w")
    counted = event_time(stream, ts, watermark).groupBy(session, *keys).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.select(*keys, local_time("w.start").alias("lease_start"), local_time("w.end").alias("expires"), "n_events")


def late_metrics(
    stream: DataFrame, keys: Sequence[str], ts: str, seconds: int, watermark: str, name: str = "arrivals"
) -> DataFrame:
    """Counts per window; rows past the watermark are left out.

    ``observe`` reports each batch's arrivals and newest time under ``name``; ``state.keep_windows``
    holds them against the rows counted and so knows how many came too late.
    """
    timed = event_time(stream, ts, watermark)
    watched = timed.observe(name, F.count(F.lit(1)).alias("arrived"), F.max(ts).alias("newest"))
    counted = watched.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, local_time("w.start").alias("start"), "n")
