"""Expected against actual: sets, columns, shards, objects and locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import moment, span
from ..operators import reconcile as R
from ..registry import query
from ..session import load
from .common import EVENTS_AS_OF, EVENTS_NOW, cents, events, sql_cents, SQL_EVENTS


def expected_dbs(spark, d):
    """Customers expected on their nation's replica set; nations 20 and up are not sharded."""
    c = load(spark, d, "customer").where("c_nationkey < 20")
    return c.select(
        F.concat(F.lit("rs-"), F.col("c_nationkey")).alias("replica_set"),
        F.concat(F.lit("db"), F.col("c_custkey")).alias("db"),
    )


def actual_dbs(spark, d):
    """Databases that orders show: some moved to the next replica set."""
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    home = (F.col("c_nationkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)) % 25
    return o.select(
        F.concat(F.lit("rs-"), home).alias("replica_set"),
        F.concat(F.lit("db"), F.col("o_custkey")).alias("db"),
        F.when(F.col("o_orderstatus") == "F", cents("o_totalprice")).otherwise(0).alias("rows_changed"),
    )


SQL_DBS = f"""
    expected AS (SELECT 'rs-' || c_nationkey AS replica_set, 'db' || c_custkey AS db FROM customer WHERE c_nationkey < 20),
    actual AS (SELECT 'rs-' || ((c_nationkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 25) AS replica_set,
      'db' || o_custkey AS db,
      CASE WHEN o_orderstatus = 'F' THEN {sql_cents('o_totalprice')} ELSE 0 END AS rows_changed
      FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "shard_mismatches",
    f"""WITH {SQL_DBS}, a AS (SELECT replica_set, db, sum(rows_changed) AS changed FROM actual GROUP BY 1, 2)
    SELECT coalesce(e.replica_set, a.replica_set) AS replica_set, coalesce(e.db, a.db) AS db,
      CASE WHEN a.db IS NULL THEN 'missing' WHEN changed <> 0 THEN 'orphaned_but_used' ELSE 'orphaned' END AS finding
    FROM expected e FULL JOIN a ON e.replica_set = a.replica_set AND e.db = a.db
    WHERE (a.db IS NULL OR e.db IS NULL)
      AND coalesce(e.replica_set, a.replica_set) IN (SELECT replica_set FROM expected)""",
)
def shard_mismatches(spark, d):
    actual = actual_dbs(spark, d)
    return R.shard_mismatches(expected_dbs(spark, d), actual.select("replica_set", "db"), actual)


@query("missing_dbs", f"WITH {SQL_DBS} SELECT replica_set, db FROM expected EXCEPT SELECT replica_set, db FROM actual WHERE rows_changed > 0")
def missing_dbs(spark, d):
    return R.missing_dbs(expected_dbs(spark, d), actual_dbs(spark, d).where("rows_changed > 0"))


@query(
    "symmetric_difference",
    f"""WITH {SQL_DBS}, l AS (SELECT replica_set, db FROM expected), r AS (SELECT replica_set, db FROM actual)
    SELECT *, 'left' AS only_in FROM (SELECT * FROM l EXCEPT SELECT * FROM r)
    UNION ALL SELECT *, 'right' AS only_in FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""",
)
def symmetric_difference(spark, d):
    return R.symmetric_difference(expected_dbs(spark, d), actual_dbs(spark, d), ["replica_set", "db"])


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    ordered = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.difference(load(spark, d, "customer"), ordered, ["c_custkey"])


@query(
    "name_collisions",
    """SELECT p_name AS table_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')
    GROUP BY 1 HAVING count(DISTINCT p_brand) = 2""",
)
def name_collisions(spark, d):
    tables = load(spark, d, "part").select(F.col("p_brand").alias("db"), F.col("p_name").alias("table_name"))
    return R.name_collisions(tables, "Brand#1", "Brand#2")


@query(
    "unused_hosts",
    """SELECT c_custkey AS hostname FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
    EXCEPT SELECT s_suppkey FROM supplier""",
)
def unused_hosts(spark, d):
    return R.unused_hosts(
        load(spark, d, "customer").select(F.col("c_custkey").alias("hostname")),
        load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("hostname")),
        load(spark, d, "supplier").select(F.col("s_suppkey").alias("hostname")),
    )


@query(
    "reconcile_columns",
    f"""WITH e AS (SELECT c_custkey, c_name, c_nationkey, {sql_cents('c_acctbal')} AS bal FROM customer WHERE c_custkey % 50 <> 3),
    a AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 1 THEN NULL ELSE c_name END AS c_name,
      c_nationkey + CASE WHEN c_custkey % 30 = 1 THEN 1 ELSE 0 END AS c_nationkey,
      {sql_cents('c_acctbal')} AS bal FROM customer WHERE c_custkey % 40 <> 7)
    SELECT coalesce(e.c_custkey, a.c_custkey) AS c_custkey,
      CASE WHEN a.c_custkey IS NULL THEN 'missing' WHEN e.c_custkey IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem,
      CASE WHEN a.c_custkey IS NULL OR e.c_custkey IS NULL THEN '' ELSE concat_ws('; ',
        CASE WHEN e.c_name IS DISTINCT FROM a.c_name THEN 'c_name: ' || coalesce(e.c_name, 'NULL') || ' -> ' || coalesce(a.c_name, 'NULL') END,
        CASE WHEN e.c_nationkey IS DISTINCT FROM a.c_nationkey THEN 'c_nationkey: ' || e.c_nationkey || ' -> ' || a.c_nationkey END) END AS differences
    FROM e FULL JOIN a ON e.c_custkey = a.c_custkey
    WHERE a.c_custkey IS NULL OR e.c_custkey IS NULL OR e.c_name IS DISTINCT FROM a.c_name OR e.c_nationkey <> a.c_nationkey""",
)
def reconcile_columns(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", cents("c_acctbal").alias("bal"))
    key = F.col("c_custkey")
    actual = c.where(key % 40 != 7).withColumns(
        {
            "c_name": F.when(key % 20 != 1, F.col("c_name")),
            "c_nationkey": F.col("c_nationkey") + F.when(key % 30 == 1, 1).otherwise(0),
        }
    )
    return R.reconcile(c.where(key % 50 != 3), actual, ["c_custkey"], ["c_name", "c_nationkey", "bal"])


@query(
    "exists_flags",
    "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') AS used FROM customer",
)
def exists_flags(spark, d):
    low = load(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"))
    return R.exists_in(load(spark, d, "customer").select("c_custkey"), low, ["c_custkey"], "used")


@query("exists_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def exists_rows(spark, d):
    partial = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.exists_in(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), partial, ["l_orderkey"])


SQL_VERIFIED = """
    work AS (SELECT DISTINCT CAST(ts AS DATE) AS backup_date, user_id % 2 = 0 AS dev_bucket FROM events),
    log AS (SELECT CAST(ts AS DATE) AS backup_date, user_id % 2 = 0 AS dev_bucket FROM events WHERE event_type = 'purchase' AND value > 120)"""


def verified(spark, d):
    e = load(spark, d, "events")
    rows = e.select(F.to_date("ts").alias("backup_date"), (F.col("user_id") % 2 == 0).alias("dev_bucket"), "event_type", "value")
    work = rows.select("backup_date", "dev_bucket").distinct()
    # An export that is not finished has a log row without a date.
    finished = (F.col("event_type") == "purchase") & (F.col("value") > 120)
    return work, rows.withColumn("backup_date", F.when(finished, F.col("backup_date")))


@query("exports_already_verified", f"WITH {SQL_VERIFIED} SELECT * FROM work WHERE (backup_date, dev_bucket) IN (SELECT (backup_date, dev_bucket) FROM log)")
def exports_already_verified(spark, d):
    return R.already_done(*verified(spark, d), ["backup_date", "dev_bucket"])


@query("exports_to_verify", f"WITH {SQL_VERIFIED} SELECT * FROM work EXCEPT SELECT * FROM log")
def exports_to_verify(spark, d):
    return R.already_done(*verified(spark, d), ["backup_date", "dev_bucket"], done=False)


@query(
    "pending_transition",
    f"""SELECT CAST(user_id AS VARCHAR) AS instance_id, event_type AS activity, ts AS happened, event_id FROM events
    WHERE event_type = 'signup' AND ts > {EVENTS_NOW} - INTERVAL 21 DAY AND ts < {EVENTS_NOW} - INTERVAL 18 HOUR
      AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)""",
)
def pending_transition(spark, d):
    e = load(spark, d, "events")
    activity = F.when((F.col("event_type") == "purchase") & (F.col("value") <= 60), "none").otherwise(F.col("event_type"))
    log = e.select(
        F.col("user_id").cast("string").alias("instance_id"), activity.alias("activity"),
        F.col("ts").alias("happened"), "event_id",
    )
    now = moment(EVENTS_AS_OF)
    window = (F.col("happened") > now - span(days=21)) & (F.col("happened") < now - span(hours=18))
    return R.pending_transition(log, "signup", "purchase", window)


@query(
    "blocked_by_remote_lock",
    f"""WITH locks AS (SELECT event_type AS table_name, user_id AS partition_number, 3306 AS port,
          'host-' || (event_id % 3) AS hostname, k < 2 AS active FROM ({SQL_EVENTS}))
    SELECT DISTINCT event_type AS table_name, user_id AS partition_number, 3306 AS port FROM events e
    WHERE EXISTS (SELECT 1 FROM locks l WHERE l.table_name = e.event_type AND l.partition_number = e.user_id
      AND l.active AND l.hostname <> 'host-1')""",
)
def blocked_by_remote_lock(spark, d):
    e = events(spark, d)
    base = e.select(
        F.col("event_type").alias("table_name"), F.col("user_id").alias("partition_number"), F.lit(3306).alias("port"),
        F.concat(F.lit("host-"), F.col("event_id") % 3).alias("hostname"), F.when(F.col("k") < 2, "active").alias("lock_active"),
    )
    parts = base.select("table_name", "partition_number", "port").distinct()
    return R.blocked_by_remote_lock(parts, base, "host-1")


# Exports ---------------------------------------------------------------------------------
# Shards are customers' nations, their type is the region; tables are order years with the month
# as partition; an object is the month's large orders of a nation.


def export_inputs(spark, d):
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    shards = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("shard_type"), F.col("n_nationkey").alias("shard")
    )
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(shards, F.col("c_nationkey") == F.col("shard")).select(
        "shard_type", "shard", F.year("o_orderdate").alias("table_name"), F.month("o_orderdate").alias("part"),
        F.when(F.col("o_totalprice") > 100000, cents("o_totalprice")).otherwise(0).alias("bytes"),
    )
    tables = o.select("shard_type", "table_name", "part").distinct()
    objects = o.groupBy("shard", "table_name", "part").agg(F.sum("bytes").alias("size"))
    return shards, tables, objects


SQL_EXPORT = f"""
    shards AS (SELECT r_name AS shard_type, n_nationkey AS shard FROM nation JOIN region ON n_regionkey = r_regionkey),
    o AS (SELECT shard_type, shard, year(o_orderdate) AS table_name, month(o_orderdate) AS part,
      CASE WHEN o_totalprice > 100000 THEN {sql_cents('o_totalprice')} ELSE 0 END AS bytes
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN shards ON c_nationkey = shard),
    tables AS (SELECT DISTINCT shard_type, table_name, part FROM o),
    objects AS (SELECT shard, table_name, part FROM o GROUP BY ALL HAVING sum(bytes) > 0),
    wanted AS (SELECT shard_type, shard, table_name, part FROM shards JOIN tables USING (shard_type)),
    status AS (SELECT w.shard_type, w.table_name, count(*) AS expected, count(b.shard) AS found,
      count(*) = count(b.shard) AS complete
      FROM wanted w LEFT JOIN objects b ON b.shard = w.shard AND b.table_name = w.table_name AND b.part = w.part GROUP BY 1, 2)"""


@query("export_status", f"WITH {SQL_EXPORT} SELECT * FROM status")
def export_status(spark, d):
    return R.export_status(*export_inputs(spark, d))


@query("expected_objects", f"WITH {SQL_EXPORT} SELECT * FROM wanted")
def expected_objects(spark, d):
    shards, tables, _ = export_inputs(spark, d)
    return R.expected_objects(shards, tables)


@query("missing_objects", f"WITH {SQL_EXPORT} SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM objects b WHERE b.shard = w.shard AND b.table_name = w.table_name AND b.part = w.part)")
def missing_objects(spark, d):
    return R.missing_objects(*export_inputs(spark, d))


@query(
    "success_marker_actions",
    f"""WITH {SQL_EXPORT} SELECT shard_type, table_name, CASE WHEN complete AND table_name % 2 = 1 THEN 'create'
      WHEN NOT complete AND table_name % 2 = 0 THEN 'remove' WHEN complete THEN 'keep' ELSE 'none' END AS action FROM status""",
)
def success_marker_actions(spark, d):
    status = R.export_status(*export_inputs(spark, d))
    return R.success_markers(status, status.where("table_name % 2 = 0"))


@query(
    "missing_schema_files",
    """SELECT DISTINCT p_brand AS db, p_name AS table_name FROM part
    EXCEPT SELECT p_brand, p_name FROM part WHERE p_size > 10""",
)
def missing_schema_files(spark, d):
    tables = load(spark, d, "part").select(F.col("p_brand").alias("db"), F.col("p_name").alias("table_name"), "p_size")
    return R.missing_schemas(tables, tables.where("p_size > 10"))
