"""Streams over the events file, run to the end of what is there, against their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.moments import moment
from ..registry import query
from ..session import load, scratch
from ..sinks.upsert import KeyedTable
from ..sources.changelog import stream_change_log
from ..sources.changes import parse_changes, read_change_stream
from ..streaming import state as U
from ..streaming import timers as M
from ..streaming import windows as V
from .common import EVENTS_AS_OF, SQL_EVENTS, cents
from .lifecycle import SQL_LOCKS, SQL_STEPS, STEPS, lock_events, step_events

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, d):
    """The events table as a stream; a folder of files is delivered a few files per batch.

    The path is a pattern, which a stream source takes for one file as well as for a folder.
    """
    raw = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 64).parquet(f"{d}/events.parque[t]")
    return raw.withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "amount": cents("value")})


def sql_windows(seconds):
    """Window starts as Spark aligns them, and what the final watermark has closed."""
    return f"make_timestamp((epoch_us(ts) // {seconds * 1000000}) * {seconds * 1000000})"


def sql_closed(end, delay):
    """Only windows that end at or before the watermark are given out."""
    return f"{end} <= (SELECT max(ts) FROM events) - INTERVAL {delay}"


@query(
    "heartbeat_lag_stream",
    f"""SELECT *, CASE WHEN seconds > 3600 THEN 'loose' WHEN seconds > 120 THEN 'normal' ELSE 'ok' END AS alert FROM (
      SELECT user_id, {sql_windows(21600)} AS start, max(ts) AS heartbeat,
        CAST(epoch(make_timestamp((epoch_us(max(ts)) // 21600000000 + 1) * 21600000000)) AS BIGINT) - epoch_us(max(ts)) // 1000000 AS seconds FROM events GROUP BY 1, 2)""",
)
def heartbeat_lag_stream(spark, d):
    """The newest windows count most to an alarm, so open ones are kept too."""
    table = KeyedTable(spark, scratch(spark, "heartbeats"), ["user_id", "start"], ["heartbeat"])
    stream = V.heartbeat_lag_stream(event_stream(spark, d), "user_id", "ts", "6 hours")
    U.merge_batches(stream, table, scratch(spark, "heartbeats-checkpoint"), "update")
    return table.read()


@query(
    "metric_windows",
    f"""SELECT event_type, start, CAST(sum(k) AS BIGINT) AS reads, CAST(sum(amount) AS BIGINT) AS changes, CAST(sum(k) AS BIGINT) // 3600 AS reads_rate, CAST(sum(amount) AS BIGINT) // 3600 AS changes_rate
    FROM (SELECT *, {sql_windows(3600)} AS start FROM ({SQL_EVENTS})) WHERE {sql_closed("start + INTERVAL 1 HOUR", "10 MINUTE")} GROUP BY 1, 2""",
)
def metric_windows(spark, d):
    values = {"reads": F.col("k"), "changes": F.col("amount")}
    return U.collect_stream(V.metric_windows(event_stream(spark, d), ["event_type"], "ts", values, 3600, "10 minutes"), "tumbling")


@query(
    "rolling_rates",
    f"""SELECT event_type, start, CAST(sum(k) AS BIGINT) AS reads, CAST(sum(k) AS BIGINT) // 7200 AS reads_rate FROM (
      SELECT event_type, k, {sql_windows(1800)} - INTERVAL 30 MINUTE * i AS start FROM ({SQL_EVENTS}), range(0, 4) r(i))
    WHERE {sql_closed("start + INTERVAL 2 HOUR", "10 MINUTE")} GROUP BY 1, 2""",
)
def rolling_rates(spark, d):
    stream = V.rolling_rates(event_stream(spark, d), ["event_type"], "ts", {"reads": F.col("k")}, 7200, 1800, "10 minutes")
    return U.collect_stream(stream, "sliding")


@query(
    "lease_sessions_stream",
    f"""WITH b AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events))
    SELECT * FROM (SELECT user_id, min(ts) AS lease_start, max(ts) + INTERVAL 6 HOUR AS expires, count(*) AS n_events FROM b GROUP BY user_id, g)
    WHERE {sql_closed("expires", "10 MINUTE")}""",
)
def lease_sessions_stream(spark, d):
    return U.collect_stream(V.lease_sessions_stream(event_stream(spark, d), ["user_id"], "ts", 6 * 3600), "leases")


# What the last watermark has passed, in whole milliseconds.
SQL_PASSED = "(SELECT make_timestamp(epoch_us(max(ts)) // 1000 * 1000) FROM events) - INTERVAL 10 MINUTE"


@query(
    "lease_stream",
    f"""WITH RECURSIVE e AS (SELECT user_id % 30 AS part, 'user-' || user_id AS holder, ts, CASE event_type WHEN 'error' THEN 'release' WHEN 'view' THEN 'extend' ELSE 'take' END AS kind,
      row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, CAST(event_id AS VARCHAR)) AS i FROM events WHERE ts <= {SQL_PASSED}),
    s AS (
      SELECT part, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS TIMESTAMP) AS t0, CAST(NULL AS TIMESTAMP) AS t1, CAST(NULL AS BIGINT) AS n,
        CAST(NULL AS VARCHAR) AS bh, CAST(NULL AS TIMESTAMP) AS b0, CAST(NULL AS TIMESTAMP) AS b1, CAST(NULL AS BIGINT) AS bn FROM e GROUP BY part
      UNION ALL
      SELECT part, i,
        CASE WHEN bh IS NULL THEN CASE WHEN kind = 'take' THEN holder END WHEN bh = holder AND kind = 'release' THEN NULL ELSE bh END,
        CASE WHEN bh IS NULL THEN CASE WHEN kind = 'take' THEN ts END WHEN bh = holder AND kind = 'release' THEN NULL ELSE b0 END,
        CASE WHEN bh IS NULL THEN CASE WHEN kind = 'take' THEN ts END WHEN bh = holder THEN CASE WHEN kind <> 'release' THEN ts END ELSE b1 END,
        CASE WHEN bh IS NULL THEN CASE WHEN kind = 'take' THEN 1 END WHEN bh = holder THEN CASE WHEN kind <> 'release' THEN bn + 1 END ELSE bn END,
        bh, b0, b1, bn
      FROM (SELECT e.*, CASE WHEN s.t1 + INTERVAL 6 HOUR > e.ts THEN s.h END AS bh, CASE WHEN s.t1 + INTERVAL 6 HOUR > e.ts THEN s.t0 END AS b0,
          CASE WHEN s.t1 + INTERVAL 6 HOUR > e.ts THEN s.t1 END AS b1, CASE WHEN s.t1 + INTERVAL 6 HOUR > e.ts THEN s.n END AS bn
        FROM s JOIN e ON e.part = s.part AND e.i = s.i + 1)),
    w AS (SELECT s.*, e.ts, e.holder, e.kind, lead(e.ts) OVER (PARTITION BY s.part ORDER BY s.i) AS next_ts FROM s LEFT JOIN e ON e.part = s.part AND e.i = s.i)
    SELECT part, holder, ts AS at, CASE WHEN bh = holder THEN 'released' WHEN bh IS NOT NULL AND kind = 'take' THEN 'refused' ELSE 'ignored' END AS outcome,
      CASE WHEN bh = holder THEN b0 END AS lease_start, CASE WHEN bh = holder THEN ts END AS last_seen, CASE WHEN bh = holder THEN bn + 1 END AS n_events, CASE WHEN bh <> holder THEN bh END AS held_by
    FROM w WHERE i > 0 AND NOT (bh IS NULL AND kind = 'take') AND NOT (bh IS NOT NULL AND bh = holder AND kind <> 'release')
    UNION ALL SELECT part, h, t1 + INTERVAL 6 HOUR, 'expired', t0, t1, n, NULL FROM w
    WHERE h IS NOT NULL AND t1 + INTERVAL 6 HOUR <= coalesce(next_ts, {SQL_PASSED})""",
)
def lease_stream(spark, d):
    """Users compete for thirty leases: most events take one, views extend it, errors release it."""
    kind = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "view", "extend").otherwise("take")
    stream = event_stream(M.stateful_session(spark), d).select(
        (F.col("user_id") % 30).alias("part"), F.concat(F.lit("user-"), F.col("user_id")).alias("holder"), kind.alias("kind"), "ts", "event_id"
    )
    return spark.read.parquet(U.stream_to_path(M.lease_stream(stream, ["part"], "ts", "event_id", seconds=6 * 3600), "lease-outcomes"))


@query(
    "retirement_changes",
    f"""WITH l AS (SELECT 'host-' || user_id AS hostname, 'i-' || (user_id % 140) AS instance_id, max(ts) FILTER (WHERE event_type = 'signup') AS r,
      max(ts) FILTER (WHERE event_type = 'view' AND event_id % 40 = 0) AS s, max(ts) FILTER (WHERE event_type = 'purchase' AND event_id % 40 = 0) AS t
      FROM events WHERE ts <= {SQL_PASSED} GROUP BY user_id)
    SELECT * FROM (SELECT hostname, instance_id, coalesce(s, r) AS happened, CASE
      WHEN s IS NULL AND r > {SQL_PASSED} - INTERVAL 18 HOUR THEN 'ADDED' WHEN s IS NULL AND r > {SQL_PASSED} - INTERVAL 21 DAY THEN 'READY_FOR_MYSQL_SHUTDOWN'
      WHEN t IS NULL AND s > {SQL_PASSED} - INTERVAL 18 HOUR THEN 'MYSQL_SHUTDOWN' WHEN t IS NULL AND s > {SQL_PASSED} - INTERVAL 21 DAY THEN 'READY_FOR_TERMINATION' END AS state FROM l)
    WHERE state IS NOT NULL""",
)
def retirement_changes(spark, d):
    """The state that each server was last said to have."""
    session = M.stateful_session(spark)
    raw = event_stream(session, d)
    stream = step_events(raw).withColumn("event_id", F.xxhash64("hostname", "ts", "activity"))
    path = U.stream_to_path(M.retirement_changes(stream, STEPS, "ts", "event_id"), "retirement-changes")
    last = spark.read.parquet(path).groupBy("hostname", "instance_id").agg(F.max_by(F.struct("happened", "state"), "at").alias("x"))
    return last.select("hostname", "instance_id", "x.happened", "x.state").where("state <> 'LEFT'")


# The second delivery has every tenth event; one whose window has closed by then is too late.
SQL_IN_TIME = f"""
    placed AS (SELECT *, {sql_windows(3600)} AS start FROM events),
    counted AS (SELECT * FROM placed WHERE event_id % 10 <> 0
      OR start + INTERVAL 1 HOUR > (SELECT max(ts) FROM events WHERE event_id % 10 <> 0) - INTERVAL 30 MINUTE)"""


def late_deliveries(spark, d):
    """Events in two deliveries, counted per hour and kept: (windows, rows that arrived)."""
    root, checkpoint = scratch(spark, "deliveries"), scratch(spark, "late-checkpoint")
    table = KeyedTable(spark, scratch(spark, "late"), ["event_type", "start"], ["n"])
    arrived = 0
    for delivery in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        load(spark, d, "events").where(delivery).write.mode("append").parquet(root)
        stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(root)
        arrived += U.keep_windows(V.late_metrics(stream, ["event_type"], "ts", 3600, "30 minutes"), table, checkpoint)
    return table.read(), arrived


@query("late_metrics", f"WITH {SQL_IN_TIME} SELECT event_type, start, count(*) AS n FROM counted GROUP BY 1, 2")
def late_metrics(spark, d):
    return late_deliveries(spark, d)[0]


@query(
    "late_rows",
    f"WITH {SQL_IN_TIME} SELECT (SELECT count(*) FROM events) AS arrived, count(*) AS counted, (SELECT count(*) FROM events) - count(*) AS dropped FROM counted",
)
def late_rows(spark, d):
    windows, arrived = late_deliveries(spark, d)
    counted = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return windows.agg(F.lit(arrived).cast("long").alias("arrived"), counted.alias("counted"), (F.lit(arrived) - counted).alias("dropped"))


@query("active_locks_stream", f"WITH {SQL_LOCKS} SELECT lock_identifier, created_at, expires, replica_set FROM s WHERE state = 'active'")
def active_locks_stream(spark, d):
    """Two events a lock: taken, then extended or released."""
    table = KeyedTable(spark, scratch(spark, "locks"), ["lock_identifier"], ["created_at"])
    stream = lock_events(event_stream(spark, d))
    held = U.active_locks_stream(stream, table, scratch(spark, "locks-checkpoint"), moment(EVENTS_AS_OF))
    return held.select("lock_identifier", "created_at", "expires", "replica_set")


@query("lifecycle_stream", f"WITH {SQL_STEPS} SELECT * FROM states WHERE state IS NOT NULL")
def lifecycle_stream(spark, d):
    keys = ["hostname", "instance_id", "activity"]
    table = KeyedTable(spark, scratch(spark, "steps"), keys, ["happened"])
    stream = step_events(event_stream(spark, d)).withColumnRenamed("ts", "happened")
    return U.lifecycle_stream(stream, table, scratch(spark, "steps-checkpoint"), moment(EVENTS_AS_OF), STEPS)


def change_lines():
    """Events as change capture JSON, with positions as logs have them, unpadded."""
    return F.to_json(
        F.struct(
            F.when(F.col("event_type") == "error", "mysql").otherwise("shop").alias("database"),
            F.lit("carts").alias("table"),
            F.when(F.col("event_id") % 7 == 0, "delete")
            .when(F.col("event_type") == "signup", "insert")
            .otherwise("update")
            .alias("type"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
            F.format_string("mysql-bin.%06d:%d", F.floor(F.col("event_id") / 500), F.col("event_id") % 500 * 97).alias("position"),
            F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")).alias("data"),
        )
    )


def change_events(spark, d):
    """Events as a stream of changes; every tenth comes twice."""
    e = load(spark, d, "events")
    event = change_lines()
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 10 == 0, 2).otherwise(1)))
    root = scratch(spark, "changes")
    e.select(event.alias("value"), copies.alias("copy")).select("value").write.text(root)
    return read_change_stream(spark, {"path": root}, excluded=["mysql"], fmt="text")


@query(
    "change_apply",
    """SELECT user_id, event_type AS kind, 'mysql-bin.' || lpad(CAST(event_id // 500 AS VARCHAR), 6, '0') || ':' || (event_id % 500 * 97) AS position
    FROM (SELECT * FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    WHERE event_id % 7 <> 0""",
)
def change_apply(spark, d):
    stream = change_events(spark, d).select(
        F.col("data")["user_id"].cast("long").alias("user_id"), F.col("data")["kind"].alias("kind"), "position",
        F.timestamp_seconds("ts").alias("ts"), "type",
    )
    table = KeyedTable(spark, scratch(spark, "current"), ["user_id"], ["log_number", "log_offset"])
    return U.change_apply(stream, table, "position", "ts", scratch(spark, "current-checkpoint"), "40 days").drop("ts", "type")


@query(
    "change_stream",
    """SELECT database, count(*) AS n, count(DISTINCT event_id) AS positions FROM (SELECT 'shop' AS database, event_id, unnest(range(CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END)) AS copy
      FROM events WHERE event_type <> 'error') GROUP BY 1""",
)
def change_stream(spark, d):
    arrived = U.collect_stream(change_events(spark, d).select("database", "position"), "arrived")
    return arrived.groupBy("database").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("positions"))


@query("resumable_mining")
def resumable_mining(spark, d):
    """Pairs arrive in two deliveries; the second call mines the second one only."""
    from ..plans.dictionary import turn_pairs

    pairs = turn_pairs(load(spark, d, "conversations")).select("conv_id", "a", "b")
    root, base = scratch(spark, "pairs"), scratch(spark, "progress")
    for delivery in (0, 1):
        pairs.where(F.col("conv_id") % 2 == delivery).write.mode("append").parquet(root)
        stream = spark.readStream.schema(pairs.schema).parquet(root)
        mined = U.resumable_mining(stream, "a", "b", ("user", "assistant"), base)
    return mined.groupBy("substr").agg(F.count(F.lit(1)).alias("freq"))


@query(
    "change_log",
    """SELECT log_number, place, user_id, kind FROM (SELECT event_id // 2500 AS log_number, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) AS place, user_id, event_type AS kind
      FROM events) WHERE kind <> 'error'""",
)
def change_log(spark, d):
    """Changes out of numbered logs: the later half of the logs comes after the stream has stopped once, and goes on where it was."""
    lines = load(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 2500).alias("log"), change_lines().alias("value"))
    half = load(spark, d, "events").agg(F.floor(F.max("event_id") / 5000)).first()[0]
    root, out, checkpoint = scratch(spark, "logs"), scratch(spark, "log-lines"), scratch(spark, "log-checkpoint")
    for part in (F.col("log") <= half, F.col("log") > half):
        # One file a log, as a server writes them.
        lines.where(part).repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.mode("append").partitionBy("log").text(root)
        U.run_available(stream_change_log(spark, root, r"log=(\d+)/part-", 64 * 1024), out, checkpoint)
    found = spark.read.parquet(out)
    place = F.row_number().over(Window.partitionBy("log_number").orderBy("log_offset")).cast("long")
    numbered = parse_changes(found.withColumn("log_offset", place), excluded=["mysql"])
    return numbered.select("log_number", F.col("log_offset").alias("place"), F.col("data")["user_id"].cast("long").alias("user_id"), F.col("data")["kind"].alias("kind"))
