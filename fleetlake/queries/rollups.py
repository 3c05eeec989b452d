"""Sums, counts, rates, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import moment
from ..operators import rollups as A
from ..operators.percentiles import PERCENTILES, histogram_percentile
from ..registry import query
from ..session import load
from .common import EVENTS_AS_OF, SQL_EVENTS, cents, events, sql_cents


def size_log(spark, d):
    return events(spark, d).select(
        F.concat(F.lit("db"), F.col("user_id") % 40).alias("db"),
        F.concat(F.col("event_type"), F.lit("_"), F.col("user_id")).alias("table_name"),
        F.to_date("ts").alias("reported_at"),
        F.col("k").alias("size_mb"),
    )


SQL_SIZE_LOG = f"""log AS (SELECT 'db' || (user_id % 40) AS db, event_type || '_' || user_id AS table_name,
      CAST(ts AS DATE) AS reported_at, k AS size_mb FROM ({SQL_EVENTS}))"""


@query(
    "db_size",
    f"""WITH {SQL_SIZE_LOG}, cur AS (SELECT db, count(DISTINCT table_name) AS n FROM log
          WHERE reported_at > DATE '2024-01-28' GROUP BY 1)
    SELECT db, CAST(sum(size_mb) AS BIGINT) AS size_mb, count(DISTINCT table_name) AS tables,
      count(DISTINCT table_name) = coalesce(any_value(n), 0) AS ok
    FROM log LEFT JOIN cur USING (db) WHERE reported_at = DATE '2024-01-30' GROUP BY db""",
)
def db_size(spark, d):
    log = size_log(spark, d)
    return A.db_size(log, log.where("reported_at > DATE'2024-01-28'"), moment(EVENTS_AS_OF))


@query(
    "approx_schema_size",
    f"SELECT l_suppkey AS db, CAST(sum({sql_cents('l_extendedprice')} + {sql_cents('l_quantity')}) AS BIGINT) // 1048576 AS size_mb FROM lineitem GROUP BY 1",
)
def approx_schema_size(spark, d):
    li = load(spark, d, "lineitem")
    return A.approx_schema_size(
        li.select(
            F.col("l_suppkey").alias("db"), cents("l_extendedprice").alias("data_length"), cents("l_quantity").alias("index_length")
        )
    )


@query(
    "activity_by_schema",
    f"""SELECT n_name AS db, CAST(coalesce(sum({sql_cents('s_acctbal')}), 0) AS BIGINT) AS rows_read, count(s_suppkey) AS rows_changed
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def activity_by_schema(spark, d):
    nation = load(spark, d, "nation")
    s = load(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    stats = s.select(F.col("n_name").alias("db"), cents("s_acctbal").alias("rows_read"), F.lit(1).cast("long").alias("rows_changed"))
    return A.activity_by_schema(nation.select(F.col("n_name").alias("db")), stats)


@query(
    "process_counts",
    """SELECT 'user' || (user_id % 9) AS "user", CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'host-' || (user_id % 7) END AS source,
      'binlog' || event_type AS command, count(*) AS cnt FROM events GROUP BY ALL""",
)
def process_counts(spark, d):
    e = load(spark, d, "events")
    host = F.concat(F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("host-"), F.col("user_id") % 7)), F.lit(":"), F.col("event_id"))
    return A.process_counts(
        e.select(
            F.concat(F.lit("USER"), F.col("user_id") % 9).alias("user"), host.alias("host"),
            F.concat(F.lit("Binlog "), F.col("event_type")).alias("command"),
        )
    )


@query("connected_users", 'SELECT DISTINCT user_id AS "user" FROM events')
def connected_users(spark, d):
    return A.connected_users(load(spark, d, "events").select(F.col("user_id").alias("user")))


@query(
    "user_activity",
    f"""SELECT event_type AS instance, user_id AS "user", CAST(sum(k) AS BIGINT) AS k, CAST(sum(amount) AS BIGINT) AS amount
    FROM ({SQL_EVENTS}) GROUP BY 1, 2""",
)
def user_activity(spark, d):
    e = events(spark, d).withColumnsRenamed({"event_type": "instance", "user_id": "user"})
    return A.user_activity(e, ["k", "amount"])


@query(
    "replicas_in_sync",
    """SELECT o_custkey AS replica_set, count(*) AS replicas,
      count(DISTINCT (o_orderstatus, o_orderkey % 2)) = 1 AND count(*) FILTER (WHERE o_orderkey % 7 = 3) = 0 AS in_sync FROM orders GROUP BY 1""",
)
def replicas_in_sync(spark, d):
    o = load(spark, d, "orders")
    return A.replicas_in_sync(
        o.select(F.col("o_custkey").alias("replica_set"), F.col("o_orderstatus").alias("log"), F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderkey") % 2).alias("pos"))
    )


SQL_DDL = """ddl AS (SELECT source AS instance, 'db' || doc_id AS db,
      'CREATE TABLE t (' || lang || ') ENGINE=InnoDB ' || CASE WHEN n_chars > 2000 THEN 'KEY_BLOCK_SIZE=8' ELSE '' END AS norm FROM documents)"""


def definitions(spark, d):
    doc = load(spark, d, "documents")
    ddl = F.concat(
        F.lit("CREATE TABLE t ("), F.col("lang"), F.lit(") ENGINE=InnoDB AUTO_INCREMENT="), F.col("doc_id"), F.lit(" "),
        F.when(F.col("n_chars") > 2000, "KEY_BLOCK_SIZE=8").otherwise(""),
    )
    return doc.select(F.col("source").alias("instance"), F.concat(F.lit("db"), F.col("doc_id")).alias("db"), ddl.alias("ddl"))


SEED_DDL = "CREATE TABLE t (en) ENGINE=InnoDB AUTO_INCREMENT=77 "


@query("schema_drift", f"WITH {SQL_DDL} SELECT md5(norm) AS hash, instance, db FROM ddl WHERE norm <> 'CREATE TABLE t (en) ENGINE=InnoDB '")
def schema_drift(spark, d):
    return A.schema_drift(definitions(spark, d), F.lit(SEED_DDL))


SQL_RESTORES = """restores AS (SELECT user_id, ts AS finished_at, event_id, CASE WHEN event_type = 'purchase' THEN 'OK' ELSE 'BAD' END AS st,
      CAST(ts - INTERVAL 1 DAY * (user_id % 40) AS DATE) AS taken FROM events)"""


def restores(spark, d):
    e = load(spark, d, "events")
    taken = F.date_format(F.col("ts") - F.make_dt_interval((F.col("user_id") % 40).cast("int")), "yyyy-MM-dd")
    file = F.format_string("xtrabackup/standard/rs-%d/rs-%d-1-3306-%s-22:34:39.xbstream", "user_id", "user_id", taken)
    return e.select(
        F.concat(F.lit("rs-"), F.col("user_id")).alias("replica_set"),
        F.when(F.col("event_type") == "purchase", "OK").otherwise("BAD").alias("restore_status"),
        F.col("ts").alias("finished_at"),
        file.alias("restore_file"),
    )


def all_sets(spark, d):
    c = load(spark, d, "customer")
    return c.select(F.concat(F.lit("rs-"), F.col("c_custkey")).alias("replica_set"), "c_acctbal")


SQL_RESTORE_AGE = f"""{SQL_RESTORES}, last AS (SELECT user_id, max_by(taken, finished_at) AS taken FROM restores WHERE st = 'OK'
      AND finished_at > TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY GROUP BY 1),
    ages AS (SELECT 'rs-' || c_custkey AS replica_set, CASE WHEN c_acctbal < 0 THEN 0
      ELSE coalesce(date_diff('day', taken, DATE '2024-04-15'), 90) END AS age FROM customer LEFT JOIN last ON user_id = c_custkey)"""


def ages(spark, d):
    sets = all_sets(spark, d)
    return A.restore_age(restores(spark, d), sets, moment("2024-04-15 00:00:00"), sets.where("c_acctbal < 0"))


@query("restore_age", f"WITH {SQL_RESTORE_AGE} SELECT * FROM ages")
def restore_age(spark, d):
    return ages(spark, d)


SQL_COUNTS = """a AS (SELECT l_returnflag AS db, CAST(l_suppkey AS VARCHAR) AS table_name, count(*) AS cnt FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_returnflag AS db, CAST(l_suppkey AS VARCHAR) AS table_name, count(*) AS cnt FROM lineitem WHERE {keep} GROUP BY 1, 2)"""
SQL_COUNT_CHECK = """SELECT * FROM (SELECT coalesce(a.db, b.db) AS db, coalesce(a.table_name, b.table_name) AS table_name,
      coalesce(a.cnt, 0) AS source_cnt, coalesce(b.cnt, 0) AS destination_cnt,
      CASE WHEN coalesce(a.cnt, 0) * (1 + {t}) < coalesce(b.cnt, 0) THEN 'too large'
           WHEN coalesce(a.cnt, 0) * (1 - {t}) > coalesce(b.cnt, 0) THEN 'too small' END AS problem
      FROM a FULL JOIN b ON a.db = b.db AND a.table_name = b.table_name) WHERE problem IS NOT NULL"""


def _counts(spark, d, keep):
    li = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("db"), F.col("l_suppkey").cast("string").alias("table_name"), "l_quantity", "l_linestatus"
    )
    keys = ["db", "table_name"]
    return A.table_row_counts(li, keys), A.table_row_counts(li.where(keep), keys)


@query("row_count_check_exact", f"WITH {SQL_COUNTS.format(keep='l_quantity < 50')} {SQL_COUNT_CHECK.format(t='CAST(0.001 AS DOUBLE)')}")
def row_count_check_exact(spark, d):
    return A.row_count_check(*_counts(spark, d, "l_quantity < 50"))


@query("row_count_check_estimated", f"WITH {SQL_COUNTS.format(keep='l_quantity < 36')} {SQL_COUNT_CHECK.format(t='CAST(0.3 AS DOUBLE)')}")
def row_count_check_estimated(spark, d):
    return A.row_count_check(*_counts(spark, d, "l_quantity < 36"), exact=False)


@query("table_row_counts", "SELECT l_suppkey AS table_name, count(*) AS cnt FROM lineitem GROUP BY 1")
def table_row_counts(spark, d):
    return A.table_row_counts(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_name")), ["table_name"])


@query(
    "row_estimate",
    """SELECT l_returnflag, 10 * count(*) AS cnt FROM lineitem
    WHERE CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8) AS BIGINT) % 10 = 0 GROUP BY 1""",
)
def row_estimate(spark, d):
    return A.row_estimate(load(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"], 10)


@query(
    "required_space",
    f"""WITH logged AS (SELECT o_custkey AS db, CAST(sum({sql_cents('o_totalprice')}) AS BIGINT) // 1048576 AS size_mb FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    est AS (SELECT o_custkey AS db, CAST(sum({sql_cents('o_totalprice')}) AS BIGINT) // 1048576 AS size_mb FROM orders GROUP BY 1)
    SELECT c_nationkey AS replica_set, CAST(sum(coalesce(l.size_mb, e.size_mb, 0)) AS BIGINT) AS required_mb,
      (CAST(0.65 AS DOUBLE) * (1000000 + 100000 * c_nationkey) - 400000) / 1024 AS available_mb
    FROM customer LEFT JOIN logged l ON l.db = c_custkey LEFT JOIN est e ON e.db = c_custkey GROUP BY 1""",
)
def required_space(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("db"), cents("o_totalprice").alias("data_length"), F.lit(0).alias("index_length"), "o_orderstatus")
    dbs = load(spark, d, "customer").select(F.col("c_custkey").alias("db"), F.col("c_nationkey").alias("replica_set"))
    need = A.required_space(dbs, A.approx_schema_size(o.where("o_orderstatus = 'F'")), A.approx_schema_size(o), ["replica_set"])
    return need.withColumn("available_mb", A.available_space(F.lit(1000000) + F.col("replica_set") * 100000, F.lit(400000)))


SQL_STATS = f"""stats AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'plain' WHEN user_id % 3 = 1 THEN 'zen_ns' || (user_id % 5) || '_' || user_id
        ELSE 'shard' || user_id END AS db, event_type AS table_name, k AS rows_read, amount AS rows_changed,
      CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'moddb_ns' || (user_id % 5) ELSE 'moddb_default' END AS namespace
      FROM ({SQL_EVENTS}))"""


def stats(spark, d):
    kind, user = F.col("user_id") % 3, F.col("user_id")
    db = F.when(kind == 0, "plain").when(kind == 1, F.concat(F.lit("zen_ns"), user % 5, F.lit("_"), user)).otherwise(F.concat(F.lit("shard"), user))
    return events(spark, d).select(db.alias("db"), F.col("event_type").alias("table_name"), F.col("k").alias("rows_read"), F.col("amount").alias("rows_changed"))


@query("table_rates", f"WITH {SQL_STATS} SELECT namespace, table_name, CAST(sum(rows_read) AS BIGINT) // 60 AS rows_read, CAST(sum(rows_changed) AS BIGINT) // 60 AS rows_changed FROM stats GROUP BY 1, 2")
def table_rates(spark, d):
    return A.table_rates(stats(spark, d), 60, F.lit("moddb-3-1"))


@query("schema_rates", f"WITH {SQL_STATS} SELECT namespace, db, CAST(sum(rows_read) AS BIGINT) // 60 AS rows_read, CAST(sum(rows_changed) AS BIGINT) // 60 AS rows_changed FROM stats GROUP BY 1, 2")
def schema_rates(spark, d):
    return A.schema_rates(stats(spark, d), 60, F.lit("moddb-3-1"))


@query(
    "user_rates",
    f"""WITH u AS (SELECT event_type || user_id AS "user", CAST(sum(k) AS BIGINT) AS k, CAST(sum(amount) AS BIGINT) AS amount FROM ({SQL_EVENTS}) GROUP BY 1)
    SELECT "user", 'k' AS metric, k // 5 AS value FROM u UNION ALL SELECT "user", 'amount', amount // 5 FROM u
    UNION ALL SELECT "user", 'busy', amount // 100 // 5 FROM u""",
)
def user_rates(spark, d):
    e = events(spark, d).withColumn("user", F.concat("event_type", F.lit("@%-"), "user_id"))
    counted = A.user_activity(e.withColumn("label", F.col("event_type")), ["k", "amount"], ["user", "label"])
    # Busy time has fractions, like 12.50.
    return A.user_rates(counted.withColumn("busy", (F.col("amount") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")), 5)


@query(
    "global_status_metrics",
    f"""SELECT lower(event_type) || event_id AS metric, CASE WHEN event_type = 'view' THEN CAST(k + 9007199254740993 AS DECIMAL(38,9)) ELSE CAST(CAST(value AS VARCHAR) AS DECIMAL(38,9)) END AS value
    FROM ({SQL_EVENTS}) WHERE event_type <> 'error'""",
)
def global_status_metrics(spark, d):
    e = events(spark, d)
    text = F.when(F.col("event_type") == "error", "OFF").when(F.col("event_type") == "view", (F.col("k") + 9007199254740993).cast("string")).otherwise(F.col("value").cast("string"))
    return A.global_status_metrics(e.select(F.concat(F.upper("event_type"), "event_id").alias("name"), text.alias("value")))


@query("non_blackhole_tables", "SELECT p_brand AS db, count(*) FILTER (WHERE p_type <> 'ECONOMY') AS tables FROM part GROUP BY 1")
def non_blackhole_tables(spark, d):
    p = load(spark, d, "part")
    engine = F.when(F.col("p_type") == "ECONOMY", "BLACKHOLE").otherwise("InnoDB")
    return A.non_blackhole_tables(p.select(F.col("p_brand").alias("db"), engine.alias("engine")))


@query(
    "writes_after_quiesce",
    f"SELECT user_id AS instance, event_type AS db, CAST(sum(k) AS BIGINT) AS rows_changed FROM ({SQL_EVENTS}) WHERE ts > TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1, 2 HAVING sum(k) <> 0",
)
def writes_after_quiesce(spark, d):
    e = events(spark, d).where(F.col("ts") > moment("2024-01-29 00:00:00"))
    return A.writes_after_quiesce(e.select(F.col("user_id").alias("instance"), F.col("event_type").alias("db"), F.col("k").alias("rows_changed")))


@query(
    "variables_map",
    f"SELECT user_id AS instance, event_type AS name, max(k) AS value FROM ({SQL_EVENTS}) GROUP BY 1, 2",
)
def variables_map(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("instance"), F.col("event_type").alias("name"), F.col("k").alias("value"))
    return A.variables_map(e).select("instance", F.explode("variables").alias("name", "value"))


@query(
    "histogram_percentile",
    f"""WITH h AS (SELECT l_returnflag, CAST(floor(log2(l_extendedprice)) AS BIGINT) AS bucket, count(*) AS n,
          CAST(sum({sql_cents('l_extendedprice')}) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS cumulative, sum(n) OVER (PARTITION BY l_returnflag) AS points FROM h)
    SELECT l_returnflag, percentile, min_by(total, bucket) / min_by(n, bucket) * 1000 AS value
    FROM c, (SELECT unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PERCENTILES)}]) AS percentile)
    WHERE CAST(cumulative AS DOUBLE) >= CAST(points AS DOUBLE) * percentile * CAST(0.01 AS DOUBLE) GROUP BY 1, 2""",
)
def histogram_percentiles(spark, d):
    li = load(spark, d, "lineitem")
    histogram = li.groupBy("l_returnflag", F.floor(F.log2("l_extendedprice")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(cents("l_extendedprice")).alias("total")
    )
    return histogram_percentile(histogram, ["l_returnflag"])
