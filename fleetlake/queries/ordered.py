"""Latest rows, upserts, lag, as-of lookups, intervals and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import moment, span
from ..operators import intervals as I
from ..operators import lag as G
from ..operators import latest as N
from ..operators import ordered as O
from ..operators import planning as Q
from ..registry import query
from ..session import load
from .common import EVENTS_AS_OF, EVENTS_NOW, ORDERS_AS_OF, ORDERS_NOW, SQL_EVENTS, events
from .rollups import SQL_RESTORE_AGE, ages

DAY = 24 * 3600


@query(
    "latest_per_key",
    """SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id FROM events
    QUALIFY rank() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC) = 1""",
)
def latest_per_key(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    return N.latest_per_key(e, ["user_id", "event_type"], "day")


@query("top_restore", f"SELECT event_id, ts FROM events WHERE event_type = 'purchase' AND ts > {EVENTS_NOW} - INTERVAL 90 DAY ORDER BY ts DESC LIMIT 1")
def top_restore(spark, d):
    e = load(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("ts") > moment(EVENTS_AS_OF) - span(days=90)))
    return N.top_rows(e.select("event_id", "ts"), [F.col("ts").desc()])


@query("first_position", "SELECT event_id, ts FROM events ORDER BY ts LIMIT 1")
def first_position(spark, d):
    return N.top_rows(load(spark, d, "events").select("event_id", "ts"), [F.col("ts")])


@query("archive_lag", "SELECT user_id, max(ts) AS binlog_creation FROM events GROUP BY 1")
def archive_lag(spark, d):
    return N.newest_value(load(spark, d, "events"), ["user_id"], "ts", "binlog_creation")


def sizes(spark, d):
    """Event counts as a size log: several reports per user and day."""
    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"), "event_id", "amount")
    cut = F.lit("2024-01-20").cast("date")
    return e.where(F.col("day") < cut), e.where(F.col("day") >= F.date_sub(cut, 3))


SQL_UPSERT = f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, amount FROM ({SQL_EVENTS})),
    b AS (SELECT *, 0 AS src FROM e WHERE day < DATE '2024-01-20' UNION ALL SELECT *, 1 FROM e WHERE day >= DATE '2024-01-17')
    SELECT user_id, day, event_id, amount FROM b QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY src DIRECTION, event_id DIRECTION) = 1"""


@query("upsert_replace", SQL_UPSERT.replace("DIRECTION", "DESC"))
def upsert_replace(spark, d):
    target, changes = sizes(spark, d)
    return N.upsert(target, changes, ["user_id", "day"], ["event_id"])


@query("upsert_ignore", SQL_UPSERT.replace("DIRECTION", "ASC"))
def upsert_ignore(spark, d):
    target, changes = sizes(spark, d)
    return N.upsert(target, changes, ["user_id", "day"], ["event_id"], "ignore")


@query(
    "overlay",
    """SELECT c_custkey, coalesce(o2, c_nationkey) AS home, CASE WHEN o2 IS NULL THEN 'base' ELSE 'over' END AS src
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o2 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""",
)
def overlay(spark, d):
    base = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("home"), F.lit("base").alias("src"))
    partial = load(spark, d, "orders").where("o_orderstatus = 'P'")
    over = partial.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("home")).withColumn("src", F.lit("over"))
    return N.overlay([base, over], ["c_custkey"])


def updates(spark, d):
    """Events as updates that each touch one field of a user's job."""
    e = events(spark, d)
    return e.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_type") == "signup", F.col("k")).alias("started"),
        F.when(F.col("event_type") == "purchase", F.col("amount")).alias("finished"),
        F.when(F.col("event_type") == "error", F.col("event_id")).alias("message"),
    )


SQL_UPDATES = f"""u AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN k END AS started,
      CASE WHEN event_type = 'purchase' THEN amount END AS finished, CASE WHEN event_type = 'error' THEN event_id END AS message FROM ({SQL_EVENTS}))"""


@query(
    "restore_progress",
    f"""WITH {SQL_UPDATES} SELECT user_id, max_by(started, ts) FILTER (WHERE started IS NOT NULL) AS started,
      max_by(finished, ts) FILTER (WHERE finished IS NOT NULL) AS finished, max_by(message, ts) FILTER (WHERE message IS NOT NULL) AS message
    FROM u GROUP BY 1""",
)
def restore_progress(spark, d):
    return N.latest_fields(updates(spark, d), ["user_id"], ["ts"], ["started", "finished", "message"])


@query(
    "restore_progress_history",
    f"""WITH {SQL_UPDATES} SELECT event_id, user_id, last_value(started IGNORE NULLS) OVER w AS current_started,
      last_value(finished IGNORE NULLS) OVER w AS current_finished, last_value(message IGNORE NULLS) OVER w AS current_message
    FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def restore_progress_history(spark, d):
    rows = N.progress_history(updates(spark, d), ["user_id"], ["ts"], ["started", "finished", "message"], O.time_slice("ts", DAY))
    return rows.drop("started", "finished", "message", "ts")


@query(
    "newest_valid_backup",
    f"""WITH b AS (SELECT user_id, ts, CAST(ts AS DATE) AS created, event_id FROM ({SQL_EVENTS}) WHERE amount > 5000 AND event_type <> 'error')
    SELECT user_id, created, ts, event_id FROM b WHERE created <= DATE '2024-01-31' AND created > DATE '2024-01-26'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created DESC, ts DESC) = 1""",
)
def newest_valid_backup(spark, d):
    e = events(spark, d).where("amount > 5000").select("user_id", "ts", F.to_date("ts").alias("created"), "event_id", "event_type")
    found = N.newest_valid_backup(e, "user_id", "created", "ts", moment(EVENTS_AS_OF), sources=F.col("event_type") != "error")
    return found.drop("event_type")


@query(
    "unarchived_logs",
    f"""WITH l AS (SELECT user_id, event_id, k FROM ({SQL_EVENTS}))
    SELECT user_id, event_id, CASE WHEN k < 60 THEN 'record' ELSE 'upload' END AS action FROM l
    WHERE k >= 40 AND event_id < (SELECT max(event_id) FROM l m WHERE m.user_id = l.user_id)""",
)
def unarchived_logs(spark, d):
    logs = events(spark, d).select("user_id", "event_id", "k")
    found = N.unarchived_logs(logs.drop("k"), logs.where("k < 40"), logs.where("k < 60"), "user_id", "event_id")
    return found


@query("prune", f"SELECT event_id FROM events WHERE ts >= {EVENTS_NOW} - INTERVAL 2 DAY")
def prune(spark, d):
    return N.prune(load(spark, d, "events"), "ts", span(days=2), moment(EVENTS_AS_OF)).select("event_id")


# Ordered building blocks -----------------------------------------------------------------


@query(
    "running_total",
    f"""SELECT event_id, CAST(sum(amount) OVER w AS BIGINT) AS so_far, count(*) OVER w AS n FROM ({SQL_EVENTS})
    WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def running_total(spark, d):
    e = events(spark, d).select("event_id", "event_type", "ts", "amount")
    totals = {"so_far": F.col("amount"), "n": F.lit(1).cast("long")}
    return O.running_total(e, ["event_type"], "ts", O.time_slice("ts", 6 * 3600), totals).select("event_id", "so_far", "n")


@query(
    "neighbours",
    """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
)
def neighbours(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", "ts")
    cut = O.time_slice("ts", 6 * 3600)
    before = O.neighbour(e, ["event_type"], ["ts"], cut, {"before": "event_id"})
    return O.neighbour(before, ["event_type"], ["ts"], cut, {"after": "event_id"}, following=True).select("event_id", "before", "after")


# Lag -------------------------------------------------------------------------------------

SQL_LOGS = f"""logs AS (SELECT user_id AS master, event_id AS log_num, amount AS size FROM ({SQL_EVENTS}) WHERE event_type <> 'purchase'),
    status AS (SELECT event_id AS instance, user_id AS master, CASE WHEN k % 10 = 0 THEN NULL ELSE event_id + k - 50 END AS io_log, k AS io_pos,
      event_id AS sql_log, k AS sql_pos FROM ({SQL_EVENTS}) WHERE event_type = 'purchase')"""


def replication(spark, d):
    e = events(spark, d)
    logs = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("master"), F.col("event_id").alias("log_num"), F.col("amount").alias("size"))
    status = e.where("event_type = 'purchase'").select(
        F.col("event_id").alias("instance"), F.col("user_id").alias("master"),
        F.when(F.col("k") % 10 != 0, F.col("event_id") + F.col("k") - 50).alias("io_log"), F.col("k").alias("io_pos"),
        F.col("event_id").alias("sql_log"), F.col("k").alias("sql_pos"),
    )
    return status, logs


def lagged(spark, d):
    status, logs = replication(spark, d)
    positions = {"io": ("io_log", "io_pos"), "sql": ("sql_log", "sql_pos")}
    return G.bytes_behind(status, logs, positions, slice_width=10_000)


def _sql_behind(p):
    at, pos = f"coalesce({p}_log, 1)", f"CASE WHEN {p}_log IS NULL THEN 1 ELSE {p}_pos END"
    return f"""{p} AS (SELECT instance, CAST(coalesce(sum(CASE WHEN log_num = {at} THEN size - {pos} ELSE size END), 0) AS BIGINT) AS {p}_bytes,
      count(log_num) FILTER (WHERE log_num > {at}) AS {p}_binlogs
      FROM status s LEFT JOIN logs l ON l.master = s.master AND log_num >= {at} GROUP BY 1)"""


SQL_LAGGED = f"{SQL_LOGS}, {_sql_behind('io')}, {_sql_behind('sql')}"


@query("bytes_behind", f"WITH {SQL_LAGGED} SELECT instance, io_bytes, io_binlogs, sql_bytes, sql_binlogs FROM io JOIN sql USING (instance)")
def bytes_behind(spark, d):
    return lagged(spark, d)


SQL_CATCH_UP = f"""s AS (SELECT event_id, user_id, ts, CASE WHEN k = 7 THEN NULL ELSE k * 40 END AS lag FROM ({SQL_EVENTS})),
    p AS (SELECT *, lag(lag) OVER w AS last, lag(ts) OVER w AS last_ts FROM s WHERE lag IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, CASE WHEN last <> 0 AND lag >= 110 THEN (last - lag) / CAST(date_diff('microsecond', last_ts, ts) // 1000000 AS DOUBLE) END AS rate FROM p),
    j AS (SELECT *, CASE WHEN rate > 0 THEN (lag - 110) / rate END AS eta_seconds FROM r)"""


@query(
    "catch_up",
    f"""WITH {SQL_CATCH_UP} SELECT event_id, lag, round(rate, 9) AS rate, round(eta_seconds, 3) AS eta_seconds,
      CASE WHEN lag < 110 THEN 'caught_up' WHEN rate IS NULL THEN 'unknown' WHEN rate > 0 THEN 'gaining' ELSE 'not_gaining' END AS state,
      CASE WHEN lag < 110 THEN NULL WHEN eta_seconds > 21600 THEN 300 WHEN eta_seconds > 3600 THEN 60 WHEN rate <= 0 THEN 60 ELSE 5 END AS next_sample_seconds
    FROM j UNION ALL SELECT event_id, lag, NULL, NULL, 'invalid', 60 FROM s WHERE lag IS NULL""",
)
def catch_up(spark, d):
    samples = events(spark, d).select("event_id", "user_id", "ts", F.when(F.col("k") != 7, F.col("k") * 40).alias("lag"))
    normal = G.NORMAL_HEARTBEAT_LAG - G.HEARTBEAT_SAFETY_MARGIN
    found = G.catch_up(samples, ["user_id"], "ts", "lag", O.time_slice("ts", DAY), normal)
    return found.select(
        "event_id", "lag", F.round("rate", 9).alias("rate"), F.round("eta_seconds", 3).alias("eta_seconds"), "state", "next_sample_seconds"
    )


@query(
    "seconds_behind",
    f"SELECT user_id, max(ts) AS heartbeat, date_diff('microsecond', max(ts), {EVENTS_NOW}) // 1000000 AS sbm FROM events GROUP BY 1",
)
def seconds_behind(spark, d):
    return G.seconds_behind(load(spark, d, "events"), "user_id", "ts", moment(EVENTS_AS_OF))


@query(
    "lag_verdict",
    f"""SELECT event_id, CASE WHEN amount <> 0 THEN 'not fully synced, bytes behind: ' || amount ELSE '' END AS none,
      concat_ws(', ', CASE WHEN k * 40 > 120 THEN 'heartbeat lag ' || k * 40 || ' > 120 seconds' END,
        CASE WHEN amount * 1000 > 10485760 THEN 'IO lag ' || amount * 1000 || ' > 10485760 bytes' END) AS normal,
      CASE WHEN k * 40 > 3600 THEN 'heartbeat lag ' || k * 40 || ' > 3600 seconds' ELSE '' END AS loose FROM ({SQL_EVENTS})""",
)
def lag_verdict(spark, d):
    e = events(spark, d)
    measures = (F.col("amount"), F.col("amount") * 1000, F.col("k") * 40)
    return e.select("event_id", *[G.lag_problems(t, *measures).alias(t) for t in ("none", "normal", "loose")])


@query(
    "log_covering",
    """SELECT e.event_id, max_by(c.event_id, c.ts) AS log FROM events e
    LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY 1""",
)
def log_covering(spark, d):
    e = load(spark, d, "events")
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    logs = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("started"), F.col("event_id").alias("log"))
    return G.log_covering(probes, logs, ["user_id"], "ts", "started", "log", lambda c: O.time_slice(c, DAY)).select("event_id", "log")


@query(
    "gtid_for_timestamp",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    l AS (SELECT user_id, ts AS started, event_id AS log FROM events WHERE event_type = 'click'),
    c AS (SELECT p.event_id, p.user_id, p.ts, max_by(log, started) AS log FROM p LEFT JOIN l ON l.user_id = p.user_id AND started <= ts GROUP BY 1, 2, 3),
    e AS (SELECT e.event_id AS gtid, e.user_id, e.ts AS seen, max_by(log, started) AS log FROM events e JOIN l ON l.user_id = e.user_id AND started <= e.ts
          WHERE e.event_type IN ('error', 'view') GROUP BY 1, 2, 3)
    SELECT event_id, c.log, min_by(gtid, seen) AS gtid FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.log = c.log
      AND seen >= ts - INTERVAL 43200 SECOND AND seen < ts + INTERVAL 43200 SECOND GROUP BY 1, 2""",
)
def gtid_for_timestamp(spark, d):
    e = load(spark, d, "events")
    cut = lambda c: O.time_slice(c, DAY)
    logs = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("started"), F.col("event_id").alias("log"))
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    ids = e.where("event_type IN ('error', 'view')").select(F.col("event_id").alias("gtid"), "user_id", F.col("ts").alias("at"))
    in_log = G.log_covering(ids, logs, ["user_id"], "at", "started", "log", cut).where("log IS NOT NULL")
    placed = G.log_covering(probes, logs, ["user_id"], "ts", "started", "log", cut)
    found = G.first_event_near(placed, in_log, ["user_id", "log"], "ts", "at", cut, ["gtid"], seconds=43200)
    return found.select("event_id", "log", "gtid")


# Intervals -------------------------------------------------------------------------------


def key_intervals(spark, d):
    """Order keys as transaction ids of their customer's segment."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ids = o.select(F.col("c_mktsegment").alias("uuid"), F.col("o_orderkey").alias("lo"), F.col("o_orderkey").alias("hi"), "o_orderstatus")
    return ids


SQL_IDS = "ids AS (SELECT c_mktsegment AS uuid, o_orderkey AS n, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)"
SQL_RUNS = "SELECT uuid, min(n) AS lo, max(n) AS hi FROM (SELECT uuid, n, n - row_number() OVER (PARTITION BY uuid ORDER BY n) AS g FROM {src}) GROUP BY uuid, g"


@query("merge_intervals", f"WITH {SQL_IDS} {SQL_RUNS.format(src='ids')}")
def merge_intervals(spark, d):
    return I.merge_intervals(key_intervals(spark, d), width=2000)


@query("gtid_subtract", f"WITH {SQL_IDS}, kept AS (SELECT * FROM ids WHERE o_orderstatus <> 'F') {SQL_RUNS.format(src='kept')}")
def gtid_subtract(spark, d):
    ids = key_intervals(spark, d)
    return I.gtid_subtract(ids, ids.where("o_orderstatus = 'F'"), width=2000)


@query("gtid_expand", f"WITH {SQL_IDS} SELECT uuid, n FROM ids")
def gtid_expand(spark, d):
    return I.gtid_expand(I.merge_intervals(key_intervals(spark, d), width=2000), step=3)


@query(
    "gtid_sets_parsed",
    """SELECT l_orderkey, 'uuid-' || l_suppkey AS uuid, l_partkey AS lo, l_partkey + l_linenumber AS hi FROM lineitem
    UNION ALL SELECT l_orderkey, 'uuid-' || l_suppkey, l_partkey + 20, l_partkey + 20 FROM lineitem
    UNION ALL SELECT l_orderkey, 'other', l_linenumber, l_linenumber FROM lineitem""",
)
def gtid_sets_parsed(spark, d):
    li = load(spark, d, "lineitem")
    text = F.concat(
        F.lit("uuid-"), "l_suppkey", F.lit(":"), "l_partkey", F.lit("-"), F.col("l_partkey") + F.col("l_linenumber"), F.lit(":"),
        F.col("l_partkey") + 20, F.lit(",\nother:"), "l_linenumber",
    )
    return I.parse_gtid_sets(li.select("l_orderkey", text.alias("gtids")), keep=["l_orderkey"])


@query("gtid_text", f"WITH {SQL_IDS}, r AS ({SQL_RUNS.format(src='ids')}) SELECT uuid || ':' || lo || CASE WHEN hi > lo THEN '-' || hi ELSE '' END AS gtid FROM r")
def gtid_text(spark, d):
    return I.gtid_text(I.merge_intervals(key_intervals(spark, d), width=2000))


# Planning --------------------------------------------------------------------------------


@query(
    "plan_restore_tests",
    f"""WITH {SQL_RESTORE_AGE}, r AS (SELECT *, row_number() OVER (ORDER BY age DESC, replica_set) AS launch_order FROM ages)
    SELECT *, launch_order <= 11 AND (age > 55 OR launch_order <= (SELECT count(*) // 60 FROM ages)) AS start_now FROM r""",
)
def plan_restore_tests(spark, d):
    return Q.plan_restore_tests(ages(spark, d))


@query(
    "next_free_name",
    """WITH i AS (SELECT 'rs-' || l_suppkey AS replica_set, max(l_linenumber) + 1 AS start FROM lineitem GROUP BY 1),
    u AS (SELECT DISTINCT 'rs-' || l_suppkey AS replica_set, 8 + l_partkey % 90 AS host_id FROM lineitem WHERE l_quantity < 45)
    SELECT replica_set, n AS host_id, replica_set || '-' || n AS hostname FROM (
      SELECT replica_set, min(n) AS n FROM i, range(1, 200) r(n) WHERE n >= start
        AND NOT EXISTS (SELECT 1 FROM u WHERE u.replica_set = i.replica_set AND u.host_id = n) GROUP BY 1)""",
)
def next_free_name(spark, d):
    li = load(spark, d, "lineitem")
    name = F.concat(F.lit("rs-"), F.col("l_suppkey")).alias("replica_set")
    inventory = li.select(name, F.col("l_linenumber").cast("long").alias("host_id"))
    used = li.where("l_quantity < 45").select(name, (F.col("l_partkey") % 90 + 8).alias("host_id"))
    return Q.next_free_name(inventory, used)


SQL_REPLACE = f"""hosts AS (SELECT c_custkey FROM customer),
    log AS (SELECT o_custkey, max(o_orderdate) AS created_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    cfg AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'slave' ELSE 'dr_slave' END AS role FROM customer WHERE c_nationkey < 20)"""


def replacements(spark, d):
    c = load(spark, d, "customer")
    kind = F.col("c_nationkey") % 3
    config = c.where("c_nationkey < 20").select(
        F.col("c_custkey").alias("host"), F.when(kind == 0, "master").when(kind == 1, "slave").otherwise("dr_slave").alias("role")
    )
    log = load(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("old_host"), F.col("o_orderkey").alias("new_host"), F.col("o_orderkey").alias("new_instance"), F.col("o_orderdate").alias("created_at")
    )
    return c.select(F.col("c_custkey").alias("hostname")), log, config


@query(
    "replacement_requests",
    f"""WITH {SQL_REPLACE} SELECT h.c_custkey AS hostname, role, CASE WHEN role IS NULL THEN 'refused_unknown' WHEN role = 'master' THEN 'refused_master'
      WHEN created_at IS NULL THEN 'new' WHEN date_diff('day', created_at, {ORDERS_NOW}) < 7 THEN 'refused_pending' ELSE 'replace_again' END AS verdict
    FROM hosts h LEFT JOIN cfg USING (c_custkey) LEFT JOIN log ON o_custkey = c_custkey""",
)
def replacement_requests(spark, d):
    return Q.replacement_requests(*replacements(spark, d), moment(ORDERS_AS_OF))


@query(
    "replacement_role",
    f"""WITH {SQL_REPLACE} SELECT o_orderkey AS new_instance, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS old_host,
      CASE WHEN o_orderstatus = 'F' AND role <> 'master' THEN role END AS role FROM orders LEFT JOIN cfg ON c_custkey = o_custkey""",
)
def replacement_role(spark, d):
    _, log, config = replacements(spark, d)
    return Q.replacement_role(load(spark, d, "orders").select(F.col("o_orderkey").alias("new_instance")), log, config)


@query(
    "replacement_ledger",
    f"""WITH {SQL_REPLACE}, v AS (SELECT h.c_custkey AS old_host FROM hosts h LEFT JOIN cfg USING (c_custkey) LEFT JOIN log ON o_custkey = c_custkey
      WHERE role IS NOT NULL AND role <> 'master' AND (created_at IS NULL OR date_diff('day', created_at, {ORDERS_NOW}) >= 7)),
    l AS (SELECT o_custkey AS old_host, o_orderkey AS new_host, o_orderdate AS created_at, 0 AS src FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT old_host FROM v))
    SELECT old_host, new_host, new_host AS new_instance, created_at FROM l
    QUALIFY row_number() OVER (PARTITION BY old_host ORDER BY src DESC, created_at DESC, new_host DESC) = 1""",
)
def replacement_ledger(spark, d):
    hosts, log, config = replacements(spark, d)
    asked = load(spark, d, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("old_host"), F.col("o_orderkey").alias("new_host"), F.col("o_orderkey").alias("new_instance"), F.col("o_orderdate").alias("created_at")
    )
    return Q.replacement_ledger(log, asked, Q.replacement_requests(hosts, log, config, moment(ORDERS_AS_OF)))
