"""Retirement states, leases and locks in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import moment, span
from ..operators import lifecycle as Y
from ..operators.ordered import time_slice
from ..registry import query
from ..session import load, materialize
from .common import EVENTS_AS_OF, EVENTS_NOW, SQL_EVENTS, events

STEPS = ("signup", "view", "purchase")


def step_events(e):
    """Users as servers, events as activities: some views and purchases are steps, other events are none."""
    step = (F.col("event_type") == "signup") | (F.col("event_id") % 40 == 0)
    return e.select(
        F.concat(F.lit("host-"), F.col("user_id")).alias("hostname"), F.concat(F.lit("i-"), F.col("user_id") % 140).alias("instance_id"),
        F.when(step, F.col("event_type")).otherwise("none").alias("activity"), "ts",
    )


def steps(spark, d):
    """Each step's last time counts."""
    log = step_events(load(spark, d, "events"))
    return log.groupBy("hostname", "instance_id", "activity").agg(F.max("ts").alias("happened"))


SQL_STEPS = f"""
    l AS (SELECT 'host-' || user_id AS hostname, 'i-' || (user_id % 140) AS instance_id, max(ts) FILTER (WHERE event_type = 'signup') AS r,
      max(ts) FILTER (WHERE event_type = 'view' AND event_id % 40 = 0) AS s, max(ts) FILTER (WHERE event_type = 'purchase' AND event_id % 40 = 0) AS t FROM events GROUP BY user_id),
    states AS (SELECT hostname, instance_id, coalesce(s, r) AS happened, CASE
      WHEN s IS NULL AND r > {EVENTS_NOW} - INTERVAL 18 HOUR THEN 'ADDED' WHEN s IS NULL AND r > {EVENTS_NOW} - INTERVAL 21 DAY THEN 'READY_FOR_MYSQL_SHUTDOWN'
      WHEN t IS NULL AND s > {EVENTS_NOW} - INTERVAL 18 HOUR THEN 'MYSQL_SHUTDOWN' WHEN t IS NULL AND s > {EVENTS_NOW} - INTERVAL 21 DAY THEN 'READY_FOR_TERMINATION' END AS state FROM l)"""


@query("lifecycle_state", f"WITH {SQL_STEPS} SELECT * FROM states WHERE state IS NOT NULL")
def lifecycle_state(spark, d):
    return Y.lifecycle_state(steps(spark, d), moment(EVENTS_AS_OF), STEPS)


@query(
    "retirement_queue",
    f"""WITH {SQL_STEPS}, inv AS (SELECT 'host-' || c_custkey AS hostname, 'i-' || (c_custkey % 130) AS id FROM customer WHERE c_acctbal > 0)
    SELECT states.*, CASE WHEN id IS NULL THEN 'gone' WHEN id <> instance_id THEN 'duplicate_hostname' ELSE 'ok' END AS "check"
    FROM states LEFT JOIN inv USING (hostname) WHERE state IS NOT NULL""",
)
def retirement_queue(spark, d):
    inventory = load(spark, d, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("host-"), F.col("c_custkey")).alias("hostname"), F.concat(F.lit("i-"), F.col("c_custkey") % 130).alias("instance_id")
    )
    return Y.retirement_queue(Y.lifecycle_state(steps(spark, d), moment(EVENTS_AS_OF), STEPS), inventory)


@query(
    "union_all_queue",
    f"""SELECT event_id, CASE WHEN ts > {EVENTS_NOW} - INTERVAL 18 HOUR THEN 'RECENT_' ELSE 'READY_' END || upper(event_type) AS state FROM events
    WHERE event_type IN ('signup', 'view') AND ts > {EVENTS_NOW} - INTERVAL 21 DAY ORDER BY state, event_id""",
)
def union_all_queue(spark, d):
    e, now = load(spark, d, "events"), moment(EVENTS_AS_OF)
    fresh, kept = F.col("ts") > now - span(hours=18), F.col("ts") > now - span(days=21)
    sets = {}
    for kind in ("signup", "view"):
        mine = e.where(F.col("event_type") == kind)
        sets[f"RECENT_{kind.upper()}"] = mine.where(fresh).select("event_id")
        sets[f"READY_{kind.upper()}"] = mine.where(kept & ~fresh).select("event_id")
    return Y.union_all_queue(sets, ["state", "event_id"])


SQL_LEASES = """
    n AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR OR kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM n),
    leases AS (SELECT user_id, min(ts) AS lease_start, max(ts) AS last_seen, coalesce(max(ts) FILTER (WHERE event_type = 'error'), max(ts) + INTERVAL 6 HOUR) AS expires, count(*) AS n_events FROM b GROUP BY user_id, g)"""


def leases(spark, d, keys):
    e = load(spark, d, "events").select("user_id", "ts", "event_type")
    return Y.lease_sessions(e, keys, "ts", time_slice("ts", 24 * 3600), F.col("event_type") == "error", 6 * 3600)


@query("lease_sessions", f"WITH {SQL_LEASES} SELECT * FROM leases")
def lease_sessions(spark, d):
    return leases(spark, d, ["user_id"])


@query(
    "lease_conflicts",
    f"""WITH {SQL_LEASES}, t AS (SELECT *, user_id % 30 AS part FROM leases)
    SELECT part, user_id, lease_start, last_seen, expires, n_events, (SELECT count(*) FROM t o WHERE o.part = t.part AND o.lease_start < t.lease_start AND o.expires > t.lease_start) AS others
    FROM t WHERE EXISTS (SELECT 1 FROM t o WHERE o.part = t.part AND o.lease_start < t.lease_start AND o.expires > t.lease_start) AND expires > lease_start""",
)
def lease_conflicts(spark, d):
    held = materialize(leases(spark, d, ["user_id"]), "leases").withColumn("part", F.col("user_id") % 30)
    alive = held.where(F.col("expires") > F.col("lease_start"))
    return Y.lease_conflicts(alive, ["part"], lambda c: time_slice(c, 24 * 3600))


def locks(spark, d):
    return lock_events(events(spark, d))


def lock_events(e):
    """Events as changes of locks, two a lock: taken, then extended or released."""
    return e.select(
        F.concat(F.lit("lock-"), F.floor(F.col("event_id") / 2).cast("long")).alias("lock_identifier"),
        F.when((F.col("event_id") % 2 == 0) | (F.col("k") < 90), "active").alias("lock_active"),
        F.col("ts").alias("created_at"), (F.col("ts") + span(hours=12)).alias("expires"),
        F.when((F.col("event_id") % 2 == 1) & (F.col("k") >= 90), F.col("ts")).alias("released"),
        F.concat(F.lit("rs-"), F.col("user_id")).alias("replica_set"),
    )


SQL_LOCKS = f"""
    l AS (SELECT 'lock-' || (event_id // 2) AS lock_identifier, CASE WHEN event_id % 2 = 0 OR k < 90 THEN 'active' END AS lock_active, ts AS created_at,
      ts + INTERVAL 12 HOUR AS expires, CASE WHEN event_id % 2 = 1 AND k >= 90 THEN ts END AS released, 'rs-' || user_id AS replica_set FROM ({SQL_EVENTS})),
    s AS (SELECT *, CASE WHEN lock_active IS NULL THEN 'released' WHEN expires < {EVENTS_NOW} THEN 'expired' ELSE 'active' END AS state
      FROM l QUALIFY row_number() OVER (PARTITION BY lock_identifier ORDER BY created_at DESC) = 1)"""


@query("lock_state", f"WITH {SQL_LOCKS} SELECT * FROM s")
def lock_state(spark, d):
    return Y.lock_state(locks(spark, d), moment(EVENTS_AS_OF))


@query("active_locks", f"WITH {SQL_LOCKS} SELECT * FROM s WHERE state = 'active'")
def active_locks(spark, d):
    return Y.active_locks(locks(spark, d), moment(EVENTS_AS_OF))


@query("lock_requests", f"WITH {SQL_LOCKS} SELECT 'rs-' || c_custkey AS replica_set, 'rs-' || c_custkey NOT IN (SELECT replica_set FROM s WHERE state = 'active') AS granted FROM customer")
def lock_requests(spark, d):
    wanted = load(spark, d, "customer").select(F.concat(F.lit("rs-"), F.col("c_custkey")).alias("replica_set"))
    return Y.lock_requests(wanted, locks(spark, d), moment(EVENTS_AS_OF))


@query(
    "migration_locks",
    f"""WITH m AS (SELECT event_id AS lock_identifier, 'rs-' || user_id AS s, 'rs-' || (k + 50) AS t FROM ({SQL_EVENTS}) WHERE event_type = 'purchase' AND k < 30),
    x AS (SELECT s AS replica_set, lock_identifier, 'source' AS side FROM m UNION ALL SELECT t, lock_identifier, 'destination' FROM m)
    SELECT * FROM x WHERE replica_set IN (SELECT 'rs-' || s_suppkey FROM supplier)""",
)
def migration_locks(spark, d):
    log = events(spark, d).where("event_type = 'purchase'").select(
        F.col("event_id").alias("lock_identifier"), F.when(F.col("k") < 30, "active").alias("lock_active"),
        F.concat(F.lit("rs-"), F.col("user_id")).alias("source_replica_set"), F.concat(F.lit("rs-"), F.col("k") + 50).alias("destination_replica_set"),
    )
    wanted = load(spark, d, "supplier").select(F.concat(F.lit("rs-"), F.col("s_suppkey")).alias("replica_set"))
    return Y.migration_locks(log, wanted)
