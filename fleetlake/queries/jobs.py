"""The composite jobs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import moment
from ..operators import lifecycle as Y
from ..operators import rollups as A
from ..plans import audits as J
from ..plans.metrics import as_metrics, rollup
from ..plans.settings import effective_settings
from ..registry import ORACLES, query
from ..session import load
from ..sinks.files import format_metrics
from ..sources.logs import parse_engine_status
from .common import EVENTS_AS_OF, EVENTS_NOW, ORDERS_AS_OF, ORDERS_NOW, SQL_EVENTS, events
from .lifecycle import STEPS, steps, SQL_STEPS
from .logs import SQL_STATUS, status_lines
from .names import grants
from .ordered import SQL_LAGGED, replication
from .reconcile import SQL_DBS, SQL_EXPORT, actual_dbs, export_inputs
from .rollups import (
    SEED_DDL,
    SQL_STATS,
    definitions,
    global_status_metrics,
    histogram_percentiles,
    process_counts,
    stats,
    user_rates,
)
from .topology import SQL_SHARDS, shard_map


@query(
    "export_audit",
    f"""WITH {SQL_EXPORT} SELECT shard_type, count(*) AS tables, count(*) FILTER (WHERE complete) AS complete_tables, CAST(sum(expected - found) AS BIGINT) AS missing,
      CASE WHEN sum(expected - found) = 0 THEN 'complete' ELSE 'incomplete' END AS verdict FROM status GROUP BY 1""",
)
def export_audit(spark, d):
    day = F.lit("2001-08-01").cast("date")
    return J.export_audit(*export_inputs(spark, d), day, moment("2001-08-02 03:00:00"), F.lit(True))


@query(
    "backup_coverage",
    f"""WITH b AS (SELECT user_id, event_id, ts, CAST(ts AS DATE) AS created FROM ({SQL_EVENTS}) WHERE amount > 3000),
    best AS (SELECT * FROM b WHERE created > DATE '2024-01-26' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created DESC, ts DESC) = 1)
    SELECT 'db-' || c_custkey AS replica_set, created, created IS NOT NULL AS covered,
      'xtrabackup/standard/db-' || c_custkey || '/db-' || c_custkey || '-1-3306-' || created || '-' || event_id || '.xbstream' AS path
    FROM customer LEFT JOIN best ON user_id = c_custkey""",
)
def backup_coverage(spark, d):
    e = events(spark, d)
    path = F.format_string(
        "xtrabackup/standard/db-%d/db-%d-1-3306-%s-%d.xbstream", "user_id", "user_id", F.date_format("ts", "yyyy-MM-dd"), "event_id"
    )
    listing = e.select(path.alias("path"), F.col("amount").alias("size"), F.col("ts").alias("modified"))
    sets = load(spark, d, "customer").select(F.concat(F.lit("db-"), F.col("c_custkey")).alias("replica_set"))
    return J.backup_coverage(listing, sets, moment(EVENTS_AS_OF), min_bytes=3000)


@query(
    "placement_audit",
    f"""WITH {SQL_SHARDS}, {SQL_DBS.replace('expected AS', 'unused AS')}, e AS (SELECT DISTINCT replica_set, mysqldb AS db FROM shards),
    a AS (SELECT replica_set, db, sum(rows_changed) AS changed FROM actual GROUP BY 1, 2)
    SELECT finding, replica_set, count(*) AS n FROM (
      SELECT coalesce(e.replica_set, a.replica_set) AS replica_set,
        CASE WHEN a.db IS NULL THEN 'missing' WHEN changed <> 0 THEN 'orphaned_but_used' ELSE 'orphaned' END AS finding
      FROM e FULL JOIN a ON e.replica_set = a.replica_set AND e.db = a.db WHERE a.db IS NULL OR e.db IS NULL)
    WHERE replica_set IN (SELECT replica_set FROM e) GROUP BY 1, 2""",
)
def placement_audit(spark, d):
    actual = actual_dbs(spark, d)
    found = J.placement_audit(shard_map(spark, d), actual.select("replica_set", "db"), actual)
    return found.groupBy("finding", "replica_set").agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_line_diff",
    """WITH one AS (SELECT DISTINCT 'CREATE TABLE t (' || lang || ') ENGINE=InnoDB ' || CASE WHEN n_chars > 2000 THEN 'KEY_BLOCK_SIZE=8' ELSE '' END AS norm FROM documents),
    drift AS (SELECT md5(norm) AS hash, norm FROM one WHERE norm <> 'CREATE TABLE t (en) ENGINE=InnoDB ')
    SELECT hash, '+' AS sign, norm AS line, 1 AS n FROM drift UNION ALL SELECT hash, '-', 'CREATE TABLE t (en) ENGINE=InnoDB ', 1 FROM drift""",
)
def schema_line_diff(spark, d):
    return J.line_diff(definitions(spark, d), F.lit(SEED_DDL))


# Twelve lines; a document's definition lacks one of them and has one more.
WIDE_DDL = "\n".join(["CREATE TABLE t (", *[f"  c{i} int," for i in range(1, 11)], ")"])


@query(
    "ordered_schema_diff",
    """WITH x AS (SELECT DISTINCT doc_id % 10 AS i, doc_id % 7 - CASE WHEN doc_id % 7 = doc_id % 10 THEN 1 ELSE 0 END AS gap, lang FROM documents),
    seed AS (SELECT k, CASE k WHEN 0 THEN 'CREATE TABLE t (' WHEN 11 THEN ')' ELSE '  c' || k || ' int,' END AS line FROM range(12) r(k)),
    edits AS (SELECT x.*, k AS spot, 0 AS o, ' ' AS sign, line FROM x, seed WHERE k <> i
      UNION ALL SELECT x.*, i - 1, 1, '-', line FROM x JOIN seed ON k = i
      UNION ALL SELECT x.*, gap, 2, '+', '  extra ' || lang FROM x)
    SELECT md5(string_agg(CASE WHEN sign <> '-' THEN line END, chr(10) ORDER BY spot, o) OVER (PARTITION BY i, gap, lang ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS hash,
      CAST(row_number() OVER (PARTITION BY i, gap, lang ORDER BY spot, o) - 1 AS INTEGER) AS place, sign, line FROM edits""",
)
def ordered_schema_diff(spark, d):
    dropped, added = F.col("doc_id") % 10, F.col("doc_id") % 7
    lines = F.split(F.lit(WIDE_DDL), "\n")
    kept = F.transform(lines, lambda line, k: F.array_compact(F.array(F.when(k != dropped, line), F.when(k == added, F.concat(F.lit("  extra "), F.col("lang"))))))
    docs = load(spark, d, "documents").select(F.array_join(F.flatten(kept), "\n").alias("ddl"))
    return J.drift_audit(docs.select(F.lit("host:3306").alias("instance"), F.lit("db").alias("db"), "ddl"), F.lit(WIDE_DDL))[1]


@query(
    "document_line_diff",
    """WITH t AS (SELECT DISTINCT md5(text) AS hash, text FROM documents),
    l AS (SELECT hash, line, count(*) AS n FROM (SELECT hash, unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY 1, 2)
    SELECT hash, '+' AS sign, line, n FROM l UNION ALL SELECT hash, '-', 'seed line', 1 FROM t""",
)
def document_line_diff(spark, d):
    docs = load(spark, d, "documents").select(F.col("text").alias("ddl"))
    return J.line_diff(docs, F.lit("seed line"))


@query(
    "server_report",
    f"""WITH {SQL_STEPS}, inv AS (SELECT 'host-' || c_custkey AS hostname, max(o_orderdate) AS launched FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
    disc AS (SELECT DISTINCT 'host-' || o_custkey AS hostname FROM orders WHERE o_orderpriority = '1-URGENT'),
    prot AS (SELECT 'host-' || s_suppkey AS hostname FROM supplier),
    unused AS (SELECT hostname FROM inv WHERE launched < {ORDERS_NOW} - INTERVAL 7 DAY EXCEPT SELECT * FROM disc EXCEPT SELECT * FROM prot),
    q AS (SELECT hostname, state FROM states WHERE state IS NOT NULL)
    SELECT coalesce(q.hostname, unused.hostname) AS hostname, coalesce(state, 'UNUSED') AS state FROM q FULL JOIN unused ON q.hostname = unused.hostname""",
)
def server_report(spark, d):
    o = load(spark, d, "orders")
    name = F.concat(F.lit("host-"), F.col("o_custkey")).alias("hostname")
    # Launch times are moved to the events' period, where the report's present lies.
    shift = F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.lit(ORDERS_AS_OF).cast("timestamp_ntz")
    inventory = o.groupBy(name).agg((F.max("o_orderdate") + shift).alias("launched"))
    discovered = o.where("o_orderpriority = '1-URGENT'").select(name).distinct()
    protected = load(spark, d, "supplier").select(F.concat(F.lit("host-"), F.col("s_suppkey")).alias("hostname"))
    return J.server_report(inventory, discovered, protected, steps(spark, d), moment(EVENTS_AS_OF), STEPS)


SQL_HEALTH = f"""
    h AS (SELECT s.instance, io_bytes, sql_bytes, date_diff('microsecond', beat, {EVENTS_NOW}) // 1000000 AS sbm, s.master, s.instance % 4 = 0 AS stopped, s.instance % 6 = 0 AS wrong
      FROM status s JOIN io USING (instance) JOIN sql USING (instance) JOIN (SELECT user_id, max(ts) AS beat FROM events GROUP BY 1) b ON b.user_id = s.master)"""


@query(
    "replication_health",
    f"""WITH {SQL_LAGGED}, {SQL_HEALTH}
    SELECT instance, io_bytes, sql_bytes, sbm, concat_ws(', ', CASE WHEN sbm > 120 THEN 'heartbeat lag ' || sbm || ' > 120 seconds' END,
      CASE WHEN stopped THEN 'IO thread not running' END, CASE WHEN wrong THEN 'Master is stray:3306 rather than expected master-' || master || ':3306' END) AS problems FROM h""",
)
def replication_health(spark, d):
    status, logs = replication(spark, d)
    host = F.concat(F.lit("replica-"), F.col("instance"))
    status = status.withColumns(
        {
            "host": host,
            "port": F.lit(3306),
            "io_running": F.when(F.col("instance") % 4 == 0, "No").otherwise("Yes"),
            "sql_running": F.lit("Yes"),
            "master_host": F.when(F.col("instance") % 6 == 0, "stray").otherwise(F.concat(F.lit("master-"), F.col("master"))),
            "master_port": F.lit(3306),
        }
    )
    members = status.select(F.concat(F.lit("rs-"), F.col("master")).alias("replica_set"), F.lit("slave").alias("role"), "host", "port")
    masters = status.select(
        F.concat(F.lit("rs-"), F.col("master")).alias("replica_set"), F.lit("master").alias("role"), F.concat(F.lit("master-"), F.col("master")).alias("host"), "port"
    ).distinct()
    beats = load(spark, d, "events").select(F.col("user_id").alias("master"), "ts")
    return J.replication_health(status, logs, beats, members.unionByName(masters), moment(EVENTS_AS_OF))


SQL_METRICS = f"""
    lines AS (
      SELECT 'host-' || user_id AS host, 'innodb.' || x.m AS metric, CAST(CAST(sum(x.v) AS BIGINT) AS VARCHAR) AS value, CASE WHEN x.t = '' THEN '' ELSE 'type=' || x.t END AS tags FROM m GROUP BY ALL
      UNION ALL SELECT 'host-0', 'tablestats.rows_read', CAST(CAST(sum(rows_read) AS BIGINT) // 60 AS VARCHAR), 'table=' || table_name || ' namespace=' || coalesce(namespace, '') FROM stats GROUP BY namespace, table_name
      UNION ALL SELECT 'host-1', 'processlist', CAST(cnt AS VARCHAR), 'user=' || "user" || ' source=' || source || ' command=' || command FROM ({ORACLES["process_counts"]})
      UNION ALL SELECT 'host-1', 'userstats.' || metric, CAST(value AS VARCHAR), 'user=' || "user" FROM ({ORACLES["user_rates"]})
      UNION ALL SELECT 'host-2', 'status.' || metric, CAST(value AS VARCHAR), '' FROM ({ORACLES["global_status_metrics"]})
      UNION ALL SELECT 'host-2', 'latency', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 'percentile=' || CAST(round(percentile * 10000) AS INTEGER) || ' flag=' || l_returnflag FROM ({ORACLES["histogram_percentile"]}))"""


@query(
    "metrics_rollup",
    f"""WITH {SQL_STATUS}, {SQL_STATS}, {SQL_METRICS}
    SELECT trim('mysql.' || metric || ' 1706659200 ' || value || ' replica_set=' || CASE WHEN s_suppkey IS NULL THEN 'undef' ELSE 'rs-' || s_nationkey END ||
      ' db_type=' || CASE WHEN s_suppkey IS NULL THEN 'undef' ELSE 'slave' END || ' ' || tags) AS value
    FROM lines LEFT JOIN supplier ON host = 'host-' || s_suppkey""",
)
def metrics_rollup(spark, d):
    engine = parse_engine_status(status_lines(spark, d)).groupBy("path", "metric", "type").agg(F.sum("value").alias("value"))
    engine = engine.select(F.col("path").alias("host"), F.lit(3306).alias("port"), "metric", "type", "value")
    engine = as_metrics(engine, F.col("metric"), F.col("value"), optional=["type"])
    rates = A.table_rates(stats(spark, d), 60, F.lit("moddb-3-1")).select(
        F.lit("host-0").alias("host"), F.lit(3306).alias("port"), F.col("table_name").alias("table"), F.coalesce("namespace", F.lit("")).alias("namespace"), "rows_read"
    )
    tables = as_metrics(rates, F.lit("tablestats.rows_read"), F.col("rows_read"), ["table", "namespace"])

    def of(rows, number):
        return rows.withColumns({"host": F.lit(f"host-{number}"), "port": F.lit(3306)})

    processes = as_metrics(of(process_counts(spark, d), 1), F.lit("processlist"), F.col("cnt"), ["user", "source", "command"])
    users = as_metrics(of(user_rates(spark, d), 1), F.concat(F.lit("userstats."), "metric"), F.col("value"), ["user"])
    status = as_metrics(of(global_status_metrics(spark, d), 2), F.concat(F.lit("status."), "metric"), F.col("value"))
    shares = of(histogram_percentiles(spark, d), 2).withColumns({"percentile": F.round(F.col("percentile") * 10000).cast("int"), "flag": F.col("l_returnflag")})
    latency = as_metrics(shares, F.lit("latency"), F.floor("value"), ["percentile", "flag"])
    config = load(spark, d, "supplier").select(
        F.concat(F.lit("host-"), F.col("s_suppkey")).alias("host"), F.lit(3306).alias("port"),
        F.concat(F.lit("rs-"), F.col("s_nationkey")).alias("replica_set"), F.lit("slave").alias("role"),
    )
    return format_metrics(rollup([engine, tables, processes, users, status, latency], config, 1706659200))


SQL_READY = f"""
    s AS (SELECT p_brand AS db, p_partkey AS table_name, p_type AS ddl, p_size AS cnt FROM part WHERE p_size <> 5),
    t AS (SELECT p_brand AS db, p_partkey AS table_name, CASE WHEN p_size = 9 THEN 'x' ELSE p_type END AS ddl,
      CASE WHEN p_size = 7 THEN p_size + 1 WHEN p_size = 8 THEN p_size - 1 ELSE p_size END AS cnt FROM part WHERE p_size <> 6),
    need AS (SELECT c_nationkey AS rs, count(*) AS required_mb FROM customer GROUP BY 1), have AS (SELECT o_custkey % 25 AS rs, count(*) / 10 AS available_mb FROM orders GROUP BY 1)"""


@query(
    "migration_readiness",
    f"""WITH {SQL_READY}
    SELECT 'table_only_on_one_side' AS problem, coalesce(s.db, t.db) AS db, coalesce(s.table_name, t.table_name) || CASE WHEN t.db IS NULL THEN ' left' ELSE ' right' END AS detail
      FROM s FULL JOIN t ON s.table_name = t.table_name WHERE s.db IS NULL OR t.db IS NULL
    UNION ALL SELECT 'schema_differs', s.db, CAST(s.table_name AS VARCHAR) FROM s JOIN t ON s.table_name = t.table_name WHERE s.ddl <> t.ddl
    UNION ALL SELECT 'row_count', coalesce(s.db, t.db), coalesce(s.table_name, t.table_name) || CASE WHEN coalesce(s.cnt, 0) < coalesce(t.cnt, 0) THEN ' too large' ELSE ' too small' END
      FROM s FULL JOIN t ON s.table_name = t.table_name WHERE coalesce(s.cnt, 0) <> coalesce(t.cnt, 0)
    UNION ALL SELECT 'disk_space', '', CAST(need.rs AS VARCHAR) FROM need JOIN have ON need.rs = have.rs WHERE available_mb < required_mb
    UNION ALL SELECT DISTINCT 'migration_lock', '', 'rs-' || s_suppkey || ' source' FROM supplier WHERE s_acctbal < 0""",
)
def migration_readiness(spark, d):
    p = load(spark, d, "part")
    tables = p.select(
        F.col("p_brand").alias("db"), F.col("p_partkey").alias("table_name"), "p_size", F.col("p_type").alias("ddl"), F.col("p_size").cast("long").alias("cnt")
    )
    size = F.col("p_size")
    target = tables.where(size != 6).withColumns(
        {
            "ddl": F.when(size == 9, "x").otherwise(F.col("ddl")),
            "cnt": F.col("cnt") + F.when(size == 7, 1).when(size == 8, -1).otherwise(0),
        }
    )
    source = tables.where(size != 5)
    required = load(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("replica_set")).agg(F.count(F.lit(1)).alias("required_mb"))
    available = load(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("replica_set")).agg((F.count(F.lit(1)) / 10).alias("available_mb"))
    s = load(spark, d, "supplier")
    name = F.concat(F.lit("rs-"), F.col("s_suppkey"))
    log = s.select(
        F.col("s_suppkey").alias("lock_identifier"), F.when(F.col("s_acctbal") < 0, "active").alias("lock_active"),
        name.alias("source_replica_set"), F.lit("elsewhere").alias("destination_replica_set"),
    )
    locks = Y.migration_locks(log, s.select(name.alias("replica_set")))
    return J.migration_readiness(source, target, source, target, required, available, locks)


@query(
    "grant_drift",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'SELECT, INSERT' ELSE 'ALL PRIVILEGES' END AS privileges,
      CASE WHEN c_custkey % 3 = 0 THEN '%' ELSE '10.%' END AS host, CASE WHEN c_acctbal < 1000 THEN 'NONE' ELSE '*AB' || c_custkey END AS pw, c_custkey % 5 = 0 AS opt FROM customer),
    e AS (SELECT * REPLACE (CASE WHEN c_custkey % 70 = 2 THEN 'USAGE' ELSE privileges END AS privileges, opt AND c_custkey % 10 = 0 AS opt) FROM a WHERE c_custkey % 90 <> 4),
    x AS (SELECT * FROM a WHERE c_custkey % 60 <> 7)
    SELECT 'user' || coalesce(e.c_custkey, x.c_custkey) AS "user", coalesce(e.host, x.host) AS host,
      CASE WHEN x.c_custkey IS NULL THEN 'missing' WHEN e.c_custkey IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem,
      CASE WHEN x.c_custkey IS NULL OR e.c_custkey IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN e.privileges <> x.privileges THEN 'privileges: ' || e.privileges || ' -> ' || x.privileges END,
        CASE WHEN e.opt <> x.opt THEN 'grant_option: ' || e.opt || ' -> ' || x.opt END) END AS differences
    FROM e FULL JOIN x ON e.c_custkey = x.c_custkey
    WHERE x.c_custkey IS NULL OR e.c_custkey IS NULL OR e.privileges <> x.privileges OR e.opt <> x.opt""",
)
def grant_drift(spark, d):
    parsed = grants(load(spark, d, "customer"))
    rows = parsed.select("c_custkey", F.col("g.username").alias("user"), F.col("g.source_host").alias("host"), "g.privileges", "g.hashed_password", "g.grant_option")
    key = F.col("c_custkey")
    expected = rows.where(key % 90 != 4).withColumns(
        {
            "privileges": F.when(key % 70 == 2, "USAGE").otherwise(F.col("privileges")),
            "grant_option": F.col("grant_option") & (key % 10 == 0),
        }
    )
    return J.grant_drift(expected, rows.where(key % 60 != 7))


def changes(spark, d):
    """One change per customer, from the customer's last order."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    c = o.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.col("k") % 6
    space = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("ns"), F.col("c_nationkey")))
    home = F.concat(F.lit("rs-"), F.col("c_nationkey"))
    return c.select(
        F.when(kind < 3, "move").when(kind == 3, "add").when(kind == 4, "add_service").otherwise("add_namespace").alias("op"),
        F.when((kind == 4) & (F.col("k") % 4 == 0), F.concat(F.lit("new"), "c_custkey")).otherwise(F.lower("c_mktsegment")).alias("service"),
        F.when((kind == 5) & (F.col("k") % 4 == 1), F.concat(F.lit("ns-new"), "c_custkey")).otherwise(space).alias("namespace"),
        F.when((kind == 3) & (F.col("k") % 4 == 3), F.concat(F.lit("n"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("shard"),
        F.when(kind == 1, "rs-x").otherwise(home).alias("old_replica_set"),
        F.when(kind == 0, "rs-99").otherwise(home).alias("new_replica_set"),
        F.concat(F.lit("db"), F.col("c_custkey") % 500).alias("mysqldb"),
    )


SQL_CHANGES = """
    c AS (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey),
    ch AS (SELECT DISTINCT CASE WHEN k % 6 < 3 THEN 'move' WHEN k % 6 = 3 THEN 'add' WHEN k % 6 = 4 THEN 'add_service' ELSE 'add_namespace' END AS op,
      CASE WHEN k % 6 = 4 AND k % 4 = 0 THEN 'new' || c_custkey ELSE lower(c_mktsegment) END AS service,
      CASE WHEN k % 6 = 5 AND k % 4 = 1 THEN 'ns-new' || c_custkey WHEN c_nationkey % 2 = 0 THEN '' ELSE 'ns' || c_nationkey END AS namespace,
      CASE WHEN k % 6 = 3 AND k % 4 = 3 THEN 'n' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS shard,
      CASE WHEN k % 6 = 1 THEN 'rs-x' ELSE 'rs-' || c_nationkey END AS old_replica_set, CASE WHEN k % 6 = 0 THEN 'rs-99' ELSE 'rs-' || c_nationkey END AS new_replica_set,
      'db' || (c_custkey % 500) AS mysqldb, k FROM c),
    judged AS (SELECT op, service, namespace, shard, old_replica_set, new_replica_set, mysqldb, CASE op
      WHEN 'move' THEN CASE WHEN k % 6 = 1 THEN 'warning' ELSE 'applied' END WHEN 'add' THEN CASE WHEN k % 4 = 3 THEN 'applied' ELSE 'warning' END
      WHEN 'add_service' THEN CASE WHEN k % 4 = 0 THEN 'applied' ELSE 'error' END ELSE CASE WHEN k % 4 = 1 THEN 'applied' ELSE 'error' END END AS outcome FROM ch)"""


@query("mapping_changes", f"WITH {SQL_CHANGES} SELECT * FROM judged")
def mapping_changes(spark, d):
    return J.mapping_changes(shard_map(spark, d), changes(spark, d))


@query(
    "changed_mapping_gaps",
    f"""WITH {SQL_SHARDS}, {SQL_CHANGES}, a AS (SELECT * FROM judged WHERE outcome = 'applied' AND op IN ('move', 'add')),
    m AS (SELECT coalesce(s.mysqldb, a.mysqldb) AS db, coalesce(a.new_replica_set, s.replica_set) AS replica_set
      FROM shards s FULL JOIN a ON a.service = s.service AND a.namespace = s.namespace AND a.shard = s.shard)
    SELECT replica_set, db FROM m EXCEPT SELECT replica_set, mysqldb FROM shards""",
)
def changed_mapping_gaps(spark, d):
    now = shard_map(spark, d)
    return J.validated_mapping(now, changes(spark, d), now.select("replica_set", F.col("mysqldb").alias("db")))[2]


def setting_layers(spark, d):
    p = load(spark, d, "part")
    kind = F.col("p_partkey") % 4
    return p.select(
        F.when(kind == 0, "default").when(kind == 1, "version").when(kind == 2, "hardware").otherwise("role").alias("layer"),
        F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("5."), F.col("p_partkey") % 3 + 5)).when(kind == 2, F.concat(F.lit("r3."), F.col("p_size") % 5))
        .otherwise(F.concat(F.lit("role"), F.col("p_size") % 5)).alias("name"),
        F.concat(F.when((F.col("p_partkey") % 28 == 3), "remove_").otherwise(""), F.lit("opt"), F.floor(F.col("p_partkey") / 4).cast("long") % 40).alias("setting"),
        F.concat(F.lit("v{host}-"), F.col("p_partkey")).alias("value"),
    ).groupBy("layer", "name", "setting").agg(F.max("value").alias("value"))


SQL_SETTINGS = """
    lay AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'version' WHEN 2 THEN 'hardware' ELSE 'role' END AS layer, p_partkey % 4 AS rank,
      CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '5.' || (p_partkey % 3 + 5) WHEN 2 THEN 'r3.' || (p_size % 5) ELSE 'role' || (p_size % 5) END AS name,
      CASE WHEN p_partkey % 28 = 3 THEN 'remove_' ELSE '' END || 'opt' || ((p_partkey // 4) % 40) AS setting, max('v{host}-' || p_partkey) AS value FROM part GROUP BY ALL),
    h AS (SELECT 'db-' || s_suppkey || '-1' AS hostname, '5.' || (s_suppkey % 3 + 5) AS version, 'r3.' || (s_suppkey % 5) AS hardware, 'role' || (s_nationkey % 5) AS role, s_suppkey, s_nationkey FROM supplier),
    w AS (SELECT hostname, setting, value FROM h JOIN lay ON (layer = 'default' OR layer = 'version' AND name = version OR layer = 'hardware' AND name = hardware OR layer = 'role' AND name = role)
      QUALIFY row_number() OVER (PARTITION BY hostname, setting ORDER BY rank DESC) = 1)"""


@query(
    "effective_settings",
    f"""WITH {SQL_SETTINGS} SELECT hostname, setting, replace(value, '{{host}}', hostname) AS value FROM w
      WHERE NOT starts_with(setting, 'remove_') AND NOT EXISTS (SELECT 1 FROM w r WHERE r.hostname = w.hostname AND r.setting = 'remove_' || w.setting)
    UNION ALL SELECT hostname, 'server_id', CAST(10 * 16777216 + s_suppkey % 256 AS VARCHAR) FROM h
    UNION ALL SELECT hostname, 'read_only', CASE s_nationkey % 3 WHEN 0 THEN 'OFF' ELSE 'ON' END FROM h""",
)
def settings_of_hosts(spark, d):
    s = load(spark, d, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    hosts = s.select(
        F.concat(F.lit("db-"), key, F.lit("-1")).alias("hostname"),
        F.concat(F.lit("5."), key % 3 + 5).alias("version"),
        F.concat(F.lit("r3."), key % 5).alias("hardware"),
        F.concat(F.lit("role"), nation % 5).alias("role"),
        F.when(nation % 3 == 0, "master").when(nation % 3 == 1, "slave").alias("replica_role"),
        F.concat(F.lit("10.0.0."), key % 256).alias("address"),
    )
    return effective_settings(hosts, setting_layers(spark, d), {"{host}": "hostname"})
