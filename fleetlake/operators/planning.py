"""Restore tests to run, names to give out, replacements already asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import first_per_key, upsert

# Limits of restore testing and server builds.
AGE_START_TESTING = 55
AGE_ALARM = 60
MAX_LAUNCHED = 10
SERVER_BUILD_DAYS = 7


def plan_restore_tests(ages: DataFrame, launched: int = MAX_LAUNCHED) -> DataFrame:
    """(replica_set, age, launch_order, start_now) of all restore tests, oldest first.

    A test is due above 55 days, and else until a sixtieth of all sets are under test; of the due
    ones the first ``launched`` and one more start now. Ties in age go by name. Sets are numbered
    within their age and moved on by the number of older ones.
    """
    by_age = ages.groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    older = F.coalesce(F.sum("n").over(Window.orderBy(F.col("age").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = by_age.select(F.col("age").alias("__age"), older.alias("__older"))
    own = F.row_number().over(Window.partitionBy("age").orderBy("replica_set"))
    numbered = ages.withColumn("__own", own).join(ahead, F.col("age").eqNullSafe(F.col("__age")))
    least = ages.agg((F.call_function("div", F.count(F.lit(1)), F.lit(AGE_ALARM))).alias("n"))
    order = (F.col("__own") + F.col("__older")).cast("int")
    due = (F.col("age") > AGE_START_TESTING) | (order <= least.scalar())
    return numbered.select(*ages.columns, order.alias("launch_order"), F.coalesce(due & (order <= launched + 1), F.lit(False)).alias("start_now"))


def next_free_name(inventory: DataFrame, used: DataFrame) -> DataFrame:
    """(replica_set, host_id, hostname): the first number above all in inventory that was never used.

    Inputs have replica_set and host_id. The answer is one above the highest or one above a used
    number, so those are the only candidates; no range is spelt out.
    """
    start = inventory.groupBy("replica_set").agg((F.coalesce(F.max("host_id"), F.lit(0)) + 1).alias("start"))
    taken = used.join(start, "replica_set").where("host_id >= start").select("replica_set", "host_id").distinct()
    candidates = start.select("replica_set", F.col("start").alias("host_id")).unionByName(
        taken.select("replica_set", (F.col("host_id") + 1).alias("host_id"))
    )
    free = candidates.join(taken, ["replica_set", "host_id"], "left_anti")
    chosen = free.groupBy("replica_set").agg(F.min("host_id").alias("host_id"))
    return chosen.withColumn("hostname", F.concat_ws("-", "replica_set", "host_id"))


def replacement_requests(
    hosts: DataFrame, log: DataFrame, config: DataFrame, as_of: Column, replace_again: bool = False
) -> DataFrame:
    """(hostname, role, verdict) for hosts to be replaced.

    ``refused_unknown`` and ``refused_master`` by topology; ``refused_pending`` when a
    replacement younger than a week exists; else ``replace_again`` or ``new``.
    """
    asked = first_per_key(log, ["old_host"], [F.col("created_at").desc(), F.col("new_host")]).select(
        F.col("old_host").alias("hostname"), "created_at"
    )
    roles = config.select(F.col("host").alias("hostname"), "role")
    known = hosts.select("hostname").distinct().join(roles, "hostname", "left").join(asked, "hostname", "left")
    age = F.timestamp_diff("DAY", F.col("created_at"), as_of)
    verdict = (
        F.when(F.col("role").isNull(), "refused_unknown")
        .when(F.col("role") == "master", "refused_master")
        .when(F.col("created_at").isNull(), "new")
        .when((age < SERVER_BUILD_DAYS) & ~F.lit(replace_again), "refused_pending")
        .otherwise("replace_again")
    )
    return known.select("hostname", "role", verdict.alias("verdict"))


def replacement_role(instances: DataFrame, log: DataFrame, config: DataFrame) -> DataFrame:
    """(new_instance, old_host, role): the role a replacement takes over; null when it may not."""
    old = log.select("new_instance", "old_host").distinct()
    roles = config.select(F.col("host").alias("old_host"), F.col("role").alias("r"))
    joined = instances.join(old, "new_instance", "left").join(roles, "old_host", "left")
    return joined.select("new_instance", "old_host", F.when(F.col("r") != "master", F.col("r")).alias("role"))


def replacement_ledger(log: DataFrame, orders: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The log after new replacements are recorded.

    ``orders`` has the log's columns; only those whose old host was judged ``new`` or
    ``replace_again`` are written, and an old host keeps its newest replacement only.
    """
    granted = verdicts.where(F.col("verdict").isin("new", "replace_again")).select(F.col("hostname").alias("old_host"))
    accepted = orders.join(granted, "old_host", "left_semi")
    return upsert(log, accepted, ["old_host"], ["created_at", "new_host"])
