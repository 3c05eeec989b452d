"""Rules on days and times; ``as_of`` stands for the present so that runs can be repeated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The daily export's grace and deadline.
EXPORT_STARTUP = dt.time(0, 15)
EXPORT_COMPLETION = dt.time(2, 30)
HEARTBEAT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def moment(as_of: str | Column) -> Column:
    """``as_of`` as a timestamp without zone."""
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


def span(hours: int = 0, days: int = 0, seconds: int = 0, minutes: int = 0) -> Column:
    """A day-time interval."""
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def in_window(ts: Column, as_of: str | Column, newer_than: Column | None = None, older_than: Column | None = None) -> Column:
    """``as_of - newer_than < ts < as_of - older_than``; both bounds are strict, either may be absent."""
    now = moment(as_of)
    result = F.lit(True)
    if newer_than is not None:
        result = result & (ts > now - newer_than)
    if older_than is not None:
        result = result & (ts < now - older_than)
    return result


def heartbeat_time(text: Column) -> Column:
    """A heartbeat's ISO text as a timestamp without zone."""
    return F.try_to_timestamp(text, F.lit(HEARTBEAT_FORMAT)).cast("timestamp_ntz")


def heartbeat_gate(heartbeat: Column, run_at: Column) -> Column:
    """``wait`` while replication is on an earlier day, ``ok`` on the run's day, ``error`` past it."""
    beat, run = F.to_date(heartbeat), F.to_date(run_at)
    return (
        F.when(beat < run, "wait").when(beat > run, "error").when(beat == run, "ok")
    )


def export_gate(backup_date: Column, as_of: Column, running: Column) -> Column:
    """Whether an export of ``backup_date`` may still be absent at ``as_of``.

    ``too_early`` before the startup grace, ``running`` before the deadline while the export
    runs; any other case must be checked. Only yesterday's export gets this leniency.
    """
    seconds = F.hour(as_of) * 3600 + F.minute(as_of) * 60 + F.second(as_of)
    startup = EXPORT_STARTUP.hour * 3600 + EXPORT_STARTUP.minute * 60
    deadline = EXPORT_COMPLETION.hour * 3600 + EXPORT_COMPLETION.minute * 60
    yesterday = F.date_sub(F.to_date(as_of), 1)
    return (
        F.when(backup_date != yesterday, "check")
        .when(seconds < startup, "too_early")
        .when((seconds < deadline) & running, "running")
        .otherwise("check")
    )
