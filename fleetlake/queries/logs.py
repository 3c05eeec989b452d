"""Tool output rendered from the tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import number_slice, ordinal
from ..registry import query
from ..session import load
from ..sources import logs as S
from .common import SQL_EVENTS, events


@query(
    "checksum_log",
    """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%m-%dT%H:%M:%S') AS ts, l_linenumber % 2 AS errors, l_suppkey % 3 AS diffs,
      l_partkey AS rows, CAST(l_quantity AS INTEGER) AS chunks, l_suppkey % 5 AS skipped, l_discount + 1 AS elapsed, 'db' || l_suppkey AS db, 'tbl.' || l_returnflag AS tbl
    FROM lineitem WHERE l_linestatus = 'F'""",
)
def checksum_log(spark, d):
    li = load(spark, d, "lineitem")
    good = F.concat(
        F.date_format("l_shipdate", "MM-dd'T'HH:mm:ss"), F.lit("   "), F.col("l_linenumber") % 2, F.lit("  "), F.col("l_suppkey") % 3,
        F.lit("  "), F.col("l_partkey"), F.lit(" "), F.col("l_quantity").cast("int"), F.lit("    "), F.col("l_suppkey") % 5, F.lit("   "),
        F.col("l_discount") + 1, F.lit(" db"), F.col("l_suppkey"), F.lit(".tbl."), F.col("l_returnflag"),
    )
    line = F.when(F.col("l_linestatus") == "F", good).otherwise("            TS ERRORS  DIFFS     ROWS  CHUNKS SKIPPED    TIME TABLE")
    return S.parse_checksum_log(li.select("l_orderkey", "l_linenumber", line.alias("line")))


@query(
    "sync_log",
    """SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber <= 5 THEN l_linenumber + l_partkey % 3 + 1 ELSE 0 END) AS BIGINT) AS diff_count FROM lineitem GROUP BY 1""",
)
def sync_log(spark, d):
    li = load(spark, d, "lineitem")
    good = F.concat(
        F.lit("#      "), F.col("l_linenumber"), F.lit(" "), F.col("l_partkey") % 3, F.lit(" 1  0 Chunk     00:00:00 00:00:01 2    db.tbl")
    )
    line = F.when(F.col("l_linenumber") <= 5, good).when(F.col("l_linenumber") == 6, "# x 1 1 1 Chunk a b 2 db.tbl").otherwise("DELETE FROM t WHERE id = 1")
    return S.parse_sync_log(li.select("l_suppkey", line.alias("line")), ["l_suppkey"])


def status_lines(spark, d):
    """Engine status text per user: one line per event, some after a header."""
    e = events(spark, d)
    k, a = F.col("k"), F.col("amount")
    line = (
        F.when(F.col("event_type") == "signup", F.format_string("OS WAIT ARRAY INFO: reservation count %d, signal count %d", k, a))
        .when(F.col("event_type") == "view", F.format_string("Mutex spin waits %d, rounds %d, OS waits %d", k, a, k + 1))
        .when(F.col("event_type") == "purchase", F.lit("merged operations:"))
        .when((F.col("event_type") == "error") & (k < 50), F.format_string("insert %d, delete mark %d, delete %d", k, a, k + 2))
        .when(F.col("event_type") == "error", F.format_string("RW-shared spins %d, OS waits %d; RW-excl spins %d, OS waits %d", k, a, k + 3, k + 4))
        .when(k < 25, F.format_string("Ibuf: size %d, free list len %d, seg size %d, %d merges", k, a, k + 5, k + 6))
        .when(k < 50, F.format_string("3 queries inside InnoDB, %d queries in queue", k))
        .when(k < 75, F.format_string("%d read views open inside InnoDB", k))
        .otherwise(F.format_string("History list length %d", a))
    )
    lines = e.select("user_id", "event_id", line.alias("line"))
    numbered = ordinal(lines, ["user_id"], ["event_id"], number_slice("event_id", 50_000), "line_no")
    return numbered.select(F.concat(F.lit("host-"), "user_id").alias("path"), "line_no", "line")


SQL_STATUS = f"""
    e AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w - 1 AS line_no FROM ({SQL_EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    m AS (
      SELECT *, unnest([{{'m': 'oswait_array.reservation_count', 't': '', 'v': k}}, {{'m': 'oswait_array.signal_count', 't': '', 'v': amount}}]) AS x FROM e WHERE event_type = 'signup'
      UNION ALL SELECT *, unnest([{{'m': 'locks.spin_waits', 't': 'mutex', 'v': k}}, {{'m': 'locks.rounds', 't': 'mutex', 'v': amount}}, {{'m': 'locks.os_waits', 't': 'mutex', 'v': k + 1}}]) FROM e WHERE event_type = 'view'
      UNION ALL SELECT *, unnest([{{'m': 'ibuf.inserts', 't': '', 'v': k}}, {{'m': 'ibuf.delete_mark', 't': '', 'v': amount}}, {{'m': 'ibuf.delete', 't': '', 'v': k + 2}}]) FROM e WHERE event_type = 'error' AND k < 50 AND before = 'purchase'
      UNION ALL SELECT *, unnest([{{'m': 'locks.spin_waits', 't': 'rw-shared', 'v': k}}, {{'m': 'locks.os_waits', 't': 'rw-shared', 'v': amount}}, {{'m': 'locks.spin_waits', 't': 'rw-exclusive', 'v': k + 3}}, {{'m': 'locks.os_waits', 't': 'rw-exclusive', 'v': k + 4}}]) FROM e WHERE event_type = 'error' AND k >= 50
      UNION ALL SELECT *, unnest([{{'m': 'ibuf.size', 't': '', 'v': k}}, {{'m': 'ibuf.free_list_len', 't': '', 'v': amount}}, {{'m': 'ibuf.seg_size', 't': '', 'v': k + 5}}, {{'m': 'ibuf.merges', 't': '', 'v': k + 6}}]) FROM e WHERE event_type = 'click' AND k < 25
      UNION ALL SELECT *, {{'m': 'queries_queued', 't': '', 'v': k}} FROM e WHERE event_type = 'click' AND k BETWEEN 25 AND 49
      UNION ALL SELECT *, {{'m': 'opened_read_views', 't': '', 'v': k}} FROM e WHERE event_type = 'click' AND k BETWEEN 50 AND 74
      UNION ALL SELECT *, {{'m': 'history_list_length', 't': '', 'v': amount}} FROM e WHERE event_type = 'click' AND k >= 75)"""


@query("engine_status", f"WITH {SQL_STATUS} SELECT 'host-' || user_id AS path, line_no, 'innodb.' || x.m AS metric, x.t AS type, x.v AS value FROM m")
def engine_status(spark, d):
    return S.parse_engine_status(status_lines(spark, d))


def binlog_lines(spark, d):
    """Decoded binlogs, one per user: a header, then commit lines and the id lines after them."""
    e = events(spark, d)
    # Hours are padded with a blank.
    stamp = F.concat(F.date_format("ts", "yyMMdd "), F.lpad(F.date_format("ts", "H"), 2, " "), F.date_format("ts", ":mm:ss"))
    path = F.concat(F.lit("mysql-bin."), "user_id").alias("path")
    rows = e.select(
        path, "event_type",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("i"), F.when(F.col("event_type") == "signup", F.concat(F.lit("#"), stamp, F.lit(" server id 1 end_log_pos 120 Start: binlog v 4, server v 5.6 created "), stamp, F.lit(" at startup")))
                         .otherwise(F.concat(F.lit("#"), stamp, F.lit(" server id 1  end_log_pos 4 GTID [commit=yes]"))).alias("line")),
                F.struct(F.lit(1).alias("i"), F.when(F.col("event_type") == "error", "COMMIT")
                         .otherwise(F.format_string("SET @@SESSION.GTID_NEXT= 'uuid-%d:%d'/*!*/;", "user_id", "event_id")).alias("line")),
            )
        ).alias("x"),
        "event_id",
    )
    return rows.select("path", (F.col("event_id") * 2 + F.col("x.i")).alias("line_no"), "x.line")


@query("binlog_starts", "SELECT 'mysql-bin.' || user_id AS path, date_trunc('second', min(ts)) AS started FROM events WHERE event_type = 'signup' GROUP BY 1")
def binlog_starts(spark, d):
    return S.binlog_starts(binlog_lines(spark, d))


@query(
    "binlog_gtids",
    """SELECT 'mysql-bin.' || user_id AS path, event_id * 2 AS line_no, date_trunc('second', ts) AS ts, 'uuid-' || user_id || ':' || event_id AS gtid
    FROM events WHERE event_type NOT IN ('signup', 'error')""",
)
def binlog_gtids(spark, d):
    return S.binlog_gtids(binlog_lines(spark, d))


@query(
    "backup_positions",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE 'mysql-bin.' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS log,
      CASE WHEN o_orderkey % 5 IN (0, 2, 3) THEN o_orderkey END AS pos,
      CASE o_orderkey % 5 WHEN 1 THEN 'b27a-e6:1-' || o_orderkey WHEN 3 THEN 'aa-1:1-5, bb-2:' || o_orderkey END AS gtid, o_orderkey % 5 = 4 AS bad FROM orders""",
)
def backup_positions(spark, d):
    o = load(spark, d, "orders")
    kind, key = F.col("o_orderkey") % 5, F.col("o_orderkey")
    log = F.concat(F.lit("mysql-bin."), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    text = (
        F.when(kind == 0, F.format_string("CHANGE MASTER TO MASTER_LOG_FILE='%s', MASTER_LOG_POS=%d\n", log, key))
        .when(kind == 1, F.format_string("SET GLOBAL gtid_purged='b27a-e6:1-%d';\nCHANGE MASTER TO MASTER_AUTO_POSITION=1\n", key))
        .when(kind == 2, F.format_string("%s\t%d\n", log, key))
        .when(kind == 3, F.format_string("%s\t%d\t\taa-1:1-5,\nbb-2:%d\n", log, key, key))
        .otherwise(F.format_string("%s\t%d\tthree", log, key))
    )
    return o.select("o_orderkey", S.parse_backup_position(text).alias("p")).select("o_orderkey", "p.*")


def error_log(spark, d):
    e = load(spark, d, "events")
    text = (
        F.when(F.col("event_type") == "signup", "[Note] mysqld: ready for connections.")
        .when(F.col("event_type") == "view", "[Note] mysqld: Shutdown complete")
        .when(F.col("event_type") == "error", "A mysqld process already exists")
        .otherwise("[Note] InnoDB: page cleaner")
    )
    return e.select(F.concat(F.lit("host-"), "user_id").alias("path"), F.col("event_id").alias("line_no"), text.alias("line"))


@query(
    "server_states",
    """SELECT 'host-' || user_id AS path, event_id AS line_no, CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'view' THEN 'STOPPED' ELSE 'ERROR' END AS state
    FROM events WHERE event_type IN ('signup', 'view', 'error')""",
)
def server_states(spark, d):
    return S.server_state_events(error_log(spark, d)).drop("line")


@query(
    "first_server_state",
    """SELECT 'host-' || user_id AS path, min_by(CASE event_type WHEN 'signup' THEN 'STARTED' WHEN 'view' THEN 'STOPPED' ELSE 'ERROR' END, event_id) AS state
    FROM events WHERE event_type IN ('signup', 'view', 'error') AND event_id >= 300 GROUP BY 1""",
)
def first_server_state(spark, d):
    return S.first_server_state(error_log(spark, d), F.lit(300))


@query("log_verdict", "SELECT 'job-' || user_id AS path, max_by(event_type, event_id) = 'purchase' AS ok FROM events GROUP BY 1")
def log_verdict(spark, d):
    e = load(spark, d, "events")
    text = F.when(F.col("event_type") == "purchase", "240101 02:00:00  innobackupex: completed OK!").otherwise("copying")
    lines = e.select(F.concat(F.lit("job-"), "user_id").alias("path"), F.col("event_id").alias("line_no"), text.alias("line"))
    return S.log_verdict(lines)
