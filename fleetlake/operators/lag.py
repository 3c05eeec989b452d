"""Replication lag in bytes, logs and seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import asof_join, neighbour, number_slice, running_total

# Lag limits in use in the fleet.
NORMAL_IO_LAG = 10485760
NORMAL_HEARTBEAT_LAG = 120
HEARTBEAT_SAFETY_MARGIN = 10
LOOSE_HEARTBEAT_LAG = 3600
LOG_SLICE = 10_000


def log_number(name: Column) -> Column:
    """Number of a log file: what follows the last dot."""
    return F.substring_index(name, ".", -1).try_cast("bigint")


def bytes_behind(
    status: DataFrame,
    logs: DataFrame,
    positions: dict[str, tuple[str, str]],
    instance: str = "instance",
    master: str = "master",
    slice_width: int = LOG_SLICE,
) -> DataFrame:
    """(instance, {name}_bytes, {name}_binlogs): what the master has beyond each position.

    ``positions`` names the (log, offset) columns of ``status``, one pair for what was read and
    one for what was applied; ``logs`` has master, log_num and size. A missing position means
    log 1, offset 1. The log at the position counts for its remainder, every later one for its
    whole size. Logs are summed from the end once, then each position finds its place by an
    as-of join: replicas and logs are never paired up.
    """
    tail = running_total(
        logs.select(master, "log_num", "size"),
        [master],
        "log_num",
        number_slice("log_num", slice_width),
        {"bytes": F.col("size"), "logs": F.lit(1).cast("long")},
        descending=True,
    ).withColumn("log", F.col("log_num"))
    asked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("name"),
                    F.coalesce(F.col(log), F.lit(1)).cast("long").alias("at"),
                    F.when(F.col(log).isNull(), 1).otherwise(F.col(pos)).cast("long").alias("pos"),
                )
                for name, (log, pos) in positions.items()
            ]
        )
    )
    probes = status.select(instance, master, asked.alias("p")).select(instance, master, "p.*")
    found = asof_join(
        probes, tail, [master], "at", "log_num",
        lambda c: number_slice(c, slice_width), ["log", "bytes", "logs"], direction="forward",
    )
    here = F.col("log") == F.col("at")
    behind = F.col("bytes") - F.when(here, F.col("pos")).otherwise(0)
    later = F.col("logs") - F.when(here, 1).otherwise(0)
    measures = []
    for name in positions:
        mine = F.col("name") == name
        measures.append(F.max(F.when(mine, F.coalesce(behind, F.lit(0)))).alias(f"{name}_bytes"))
        measures.append(F.max(F.when(mine, F.coalesce(later, F.lit(0)))).alias(f"{name}_binlogs"))
    return found.groupBy(instance).agg(*measures)


def catch_up(samples: DataFrame, keys: Sequence[str], ts: str, lag: str, slice_col: Column, normal: int) -> DataFrame:
    """Rate of catching up, time left and seconds to the next sample, per lag sample.

    The rate compares with the last valid sample. Without one there is no estimate; a replica
    that is not gaining has none either and is looked at again in 60 s, as is an invalid sample.
    """
    usable = samples.where(F.col(lag).isNotNull())
    paired = neighbour(usable, keys, [ts], slice_col, {"__last": lag, "__last_ts": ts})
    value, last = F.col(lag), F.col("__last")
    waited = F.timestamp_diff("SECOND", F.col("__last_ts"), F.col(ts))
    rate = F.when(last != 0, F.try_divide((last - value).cast("double"), waited.cast("double")))
    behind = value >= normal
    eta = F.when(behind & (rate > 0), (value - normal) / rate)
    state = (
        F.when(~behind, "caught_up")
        .when(rate.isNull(), "unknown")
        .when(rate > 0, "gaining")
        .otherwise("not_gaining")
    )
    wait = (
        F.when(~behind, F.lit(None))
        .when(eta > 6 * 60 * 60, 300)
        .when(eta > 60 * 60, 60)
        .when(rate <= 0, 60)
        .otherwise(5)
    )
    judged = paired.withColumns(
        {"rate": F.when(behind, rate), "eta_seconds": eta, "state": state, "next_sample_seconds": wait}
    ).drop("__last", "__last_ts")
    invalid = samples.where(F.col(lag).isNull()).withColumns(
        {"state": F.lit("invalid"), "next_sample_seconds": F.lit(60)}
    )
    return judged.unionByName(invalid, allowMissingColumns=True)


def seconds_behind(heartbeats: DataFrame, server: str, ts: str, as_of: Column) -> DataFrame:
    """(server, heartbeat, sbm): age of each server's newest heartbeat."""
    newest = heartbeats.groupBy(server).agg(F.max(ts).alias("heartbeat"))
    return newest.withColumn("sbm", F.timestamp_diff("SECOND", F.col("heartbeat"), as_of))


def lag_problems(tolerance: str, sql_bytes: Column, io_bytes: Column, sbm: Column) -> Column:
    """What is wrong with a replica's lag at a tolerance (none, normal or loose); empty if nothing."""
    if tolerance == "none":
        checks = [F.when(sql_bytes != 0, F.concat(F.lit("not fully synced, bytes behind: "), sql_bytes))]
    elif tolerance == "normal":
        checks = [
            F.when(
                sbm > NORMAL_HEARTBEAT_LAG,
                F.concat(F.lit("heartbeat lag "), sbm, F.lit(f" > {NORMAL_HEARTBEAT_LAG} seconds")),
            ),
            F.when(
                io_bytes > NORMAL_IO_LAG,
                F.concat(F.lit("IO lag "), io_bytes, F.lit(f" > {NORMAL_IO_LAG} bytes")),
            ),
        ]
    elif tolerance == "loose":
        checks = [
            F.when(
                sbm > LOOSE_HEARTBEAT_LAG,
                F.concat(F.lit("heartbeat lag "), sbm, F.lit(f" > {LOOSE_HEARTBEAT_LAG} seconds")),
            )
        ]
    else:
        raise ValueError(f"unknown lag tolerance {tolerance}")
    return F.array_join(F.array_compact(F.array(*checks)), ", ")


def log_covering(probes: DataFrame, logs: DataFrame, keys: Sequence[str], ts: str, started: str, log: str, slice_of) -> DataFrame:
    """Add the newest log that began at or before the probe's time; null if there is none."""
    return asof_join(probes, logs, keys, ts, started, slice_of, [log])


def first_event_near(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    event_ts: str,
    slice_of,
    columns: Sequence[str],
    seconds: int = 1,
    tie: str | None = None,
) -> DataFrame:
    """Add the first event in [ts - seconds, ts + seconds) of the same keys; null if there is none."""
    reach = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    early = probes.withColumn("__from", F.col(ts) - reach)
    source = events.withColumn("__seen", F.col(event_ts))
    found = asof_join(
        early, source, keys, "__from", event_ts, slice_of, ["__seen", *columns], direction="forward", tie=tie
    )
    near = F.col("__seen") < F.col(ts) + reach
    return found.withColumns({c: F.when(near, F.col(c)) for c in columns}).drop("__seen", "__from")
