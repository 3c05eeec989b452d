"""States that follow from event logs: retirement, leases, locks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import first_per_key
from .ordered import carry_last, neighbour, running_total

# Activities, ages and lease times in use in the fleet.
RESET_STATS = "Reset statistics"
SHUTDOWN_MYSQL = "Shutdown MySQL"
TERMINATE_INSTANCE = "Terminate instance"
SETTLE_HOURS = 18
QUEUE_DAYS = 21
LEASE_SECONDS = 300
LOCK_HOURS = 12


def lifecycle_state(
    log: DataFrame, as_of: Column, activities: Sequence[str] = (RESET_STATS, SHUTDOWN_MYSQL, TERMINATE_INSTANCE)
) -> DataFrame:
    """(hostname, instance_id, happened, state) of servers in the retirement queue.

    ADDED and MYSQL_SHUTDOWN for 18 hours after the step, then READY_FOR_MYSQL_SHUTDOWN and
    READY_FOR_TERMINATION for three weeks; exactly 18 hours counts as ready. One pass over the
    log: the three steps of an instance become columns of one row.
    """
    reset, shutdown, terminate = activities
    steps = log.where(F.col("activity").isin(*activities)).groupBy("hostname", "instance_id").agg(
        F.max(F.when(F.col("activity") == reset, F.col("happened"))).alias("reset_at"),
        F.max(F.when(F.col("activity") == shutdown, F.col("happened"))).alias("shutdown_at"),
        F.max(F.when(F.col("activity") == terminate, F.col("happened"))).alias("terminate_at"),
    )
    recent = as_of - F.make_dt_interval(F.lit(0), F.lit(SETTLE_HOURS))
    oldest = as_of - F.make_dt_interval(F.lit(QUEUE_DAYS))
    waiting_shutdown = F.col("shutdown_at").isNull() & (F.col("reset_at") > oldest)
    waiting_end = F.col("terminate_at").isNull() & (F.col("shutdown_at") > oldest)
    state = (
        F.when(waiting_shutdown & (F.col("reset_at") > recent), "ADDED")
        .when(waiting_shutdown, "READY_FOR_MYSQL_SHUTDOWN")
        .when(waiting_end & (F.col("shutdown_at") > recent), "MYSQL_SHUTDOWN")
        .when(waiting_end, "READY_FOR_TERMINATION")
    )
    happened = F.when(F.col("shutdown_at").isNull(), F.col("reset_at")).otherwise(F.col("shutdown_at"))
    states = steps.select("hostname", "instance_id", happened.alias("happened"), state.alias("state"))
    return states.where("state IS NOT NULL")


def retirement_queue(states: DataFrame, inventory: DataFrame) -> DataFrame:
    """Queue states checked against the inventory: ``ok``, ``gone`` or ``duplicate_hostname``."""
    known = inventory.select("hostname", F.col("instance_id").alias("__id"))
    verdict = (
        F.when(F.col("__id").isNull(), "gone")
        .when(F.col("__id") != F.col("instance_id"), "duplicate_hostname")
        .otherwise("ok")
    )
    return states.join(known, "hostname", "left").withColumn("check", verdict).drop("__id")


def union_all_queue(sets: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Several sets, each labelled with its state, as one sorted list."""
    result = None
    for state, rows in sets.items():
        part = rows.withColumn("state", F.lit(state))
        result = part if result is None else result.unionByName(part)
    return result.orderBy(*order)


def sessions(
    events: DataFrame, keys: Sequence[str], ts: str, gap: Column, slice_col: Column, ends: Column | None = None
) -> DataFrame:
    """Events with ``session_start``: a new session begins after a gap, or after an ending event.

    Works slice by slice, so the events of a hot key are spread over tasks.
    """
    marked = events.withColumn("__ends", F.coalesce(ends, F.lit(False)) if ends is not None else F.lit(False))
    near = neighbour(marked, keys, [ts], slice_col, {"__before": ts, "__ended": "__ends"})
    begins = F.col("__before").isNull() | (F.col(ts) - F.col("__before") >= gap) | F.col("__ended")
    placed = carry_last(near, keys, [ts], slice_col, {"session_start": F.when(begins, F.col(ts))})
    return placed.drop("__ends", "__before", "__ended")


def lease_sessions(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    slice_col: Column,
    released: Column | None = None,
    seconds: int = LEASE_SECONDS,
) -> DataFrame:
    """(keys, lease_start, last_seen, expires, n_events): one row per lease.

    A lease lives ``seconds`` past its last extension; a release ends it at once.
    """
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    flagged = events.withColumn("__released", released if released is not None else F.lit(False))
    placed = sessions(flagged, keys, ts, gap, slice_col, F.col("__released"))
    leases = placed.groupBy(*keys, F.col("session_start").alias("lease_start")).agg(
        F.max(ts).alias("last_seen"),
        F.max(F.when(F.col("__released"), F.col(ts))).alias("__released_at"),
        F.count(F.lit(1)).alias("n_events"),
    )
    expires = F.coalesce(F.col("__released_at"), F.col("last_seen") + gap)
    return leases.select(*keys, "lease_start", "last_seen", expires.alias("expires"), "n_events")


def lease_conflicts(leases: DataFrame, keys: Sequence[str], slice_of, start: str = "lease_start", end: str = "expires") -> DataFrame:
    """Leases taken while another one on the same keys was still alive.

    Starts and ends are counted along each key; leases are not paired with each other.
    """
    borders = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
        F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")),
    )
    line = leases.select("*", F.explode(borders).alias("b")).select(
        "*", F.col("b.at").alias("__at"), F.col("b.step").alias("__step")
    )
    # Ends come before starts at one moment: an expired lease no longer blocks.
    counted = running_total(
        line, keys, "__at", slice_of(F.col("__at")), {"alive": F.col("__step")}, tie=["__step", start]
    )
    taken = counted.where((F.col("__step") == 1) & (F.col("alive") > 1))
    return taken.select(*leases.columns, (F.col("alive") - 1).alias("others"))


def lock_state(log: DataFrame, as_of: Column) -> DataFrame:
    """Newest row of each lock, with ``state``: active, expired or released."""
    newest = first_per_key(
        log, ["lock_identifier"], [F.col("created_at").desc(), F.col("released").desc_nulls_last()]
    )
    state = (
        F.when(F.col("lock_active").isNull(), "released")
        .when(F.col("expires") < as_of, "expired")
        .otherwise("active")
    )
    return newest.withColumn("state", state)


def active_locks(log: DataFrame, as_of: Column) -> DataFrame:
    """Locks in force."""
    return lock_state(log, as_of).where("state = 'active'")


def lock_requests(requests: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """(replica_set, granted): a lock is granted unless one is in force on the replica set."""
    held = active_locks(log, as_of).select("replica_set").distinct().withColumn("__held", F.lit(True))
    wanted = requests.select("replica_set").distinct().join(held, "replica_set", "left")
    return wanted.select("replica_set", F.col("__held").isNull().alias("granted"))


def migration_locks(log: DataFrame, replica_sets: DataFrame) -> DataFrame:
    """(replica_set, lock_identifier, side) of active migrations that touch a replica set."""
    sides = F.explode(
        F.array(
            F.struct(F.col("source_replica_set").alias("rs"), F.lit("source").alias("side")),
            F.struct(F.col("destination_replica_set").alias("rs"), F.lit("destination").alias("side")),
        )
    )
    touched = log.where(F.col("lock_active") == "active").select("lock_identifier", sides.alias("x"))
    touched = touched.select(F.col("x.rs").alias("replica_set"), "lock_identifier", "x.side")
    return touched.join(replica_sets.select("replica_set").distinct(), "replica_set", "left_semi")
