"""Filters on schemas, tables, hosts and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.moments import in_window, moment, span
from ..functions.text import normalize_ddl, redact_pattern, redact_text
from ..operators import filters as P
from ..registry import query
from ..session import load
from .common import EVENTS_AS_OF, EVENTS_NOW, ORDERS_AS_OF, ORDERS_NOW, events, SQL_EVENTS


@query("user_schemas", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')")
def user_schemas(spark, d):
    return P.user_schemas(load(spark, d, "events").select("event_id", "event_type"), "event_type", ("error", "view"))


def tables(spark, d):
    """Parts as tables: brand is the schema, type the engine, size the partition count."""
    p = load(spark, d, "part")
    return p.select(
        "p_partkey", "p_type", "p_size",
        F.lower(F.regexp_replace("p_brand", "#", "")).alias("db"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey")).alias("table_name"),
        F.when(F.col("p_size") % 4 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.when(F.col("p_type") == "ECONOMY", "InnoDB").when(F.col("p_type") == "SMALL", "MyISAM").otherwise("BLACKHOLE").alias("engine"),
    )


SQL_TABLES = """
    t AS (SELECT p_partkey, p_type, p_size, lower(replace(p_brand, '#', '')) AS db,
      replace(p_name, ' ', '_') || '_' || p_partkey AS table_name,
      CASE WHEN p_size % 4 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
      CASE p_type WHEN 'ECONOMY' THEN 'InnoDB' WHEN 'SMALL' THEN 'MyISAM' ELSE 'BLACKHOLE' END AS engine FROM part)"""


@query("base_tables", f"WITH {SQL_TABLES} SELECT db, table_name, db || '.' || table_name AS full_name FROM t WHERE table_type = 'BASE TABLE' AND engine IN ('InnoDB', 'MyISAM')")
def base_tables(spark, d):
    return P.base_tables(tables(spark, d))


@query("base_tables_and_views", f"WITH {SQL_TABLES} SELECT db, table_name, db || '.' || table_name AS full_name FROM t WHERE table_type = 'VIEW' OR engine IN ('InnoDB', 'MyISAM')")
def base_tables_and_views(spark, d):
    return P.base_tables(tables(spark, d), views=True)


RULES = {
    "brand3": {"skipped_tables": [], "priority_tables": [r".*_ring"]},
    "SHARDED": {"skipped_tables": [r"[^.]+\.red", r".*widget_1"], "priority_tables": [r".*gear"]},
    "FLEXSHARD": {"skipped_tables": [r".*bolt"], "priority_tables": [r"brand2\d\.small"]},
    "NONSHARDED": {"skipped_tables": [r".*_\d*7$"], "priority_tables": []},
}


@query(
    "select_for_export",
    f"""WITH {SQL_TABLES}, q AS (SELECT db AS prefix, db || '.' || table_name AS full_name, p_size % 4 AS parts,
      CASE WHEN db = 'brand3' THEN 'brand3' WHEN db IN ('brand1', 'brand2') THEN 'SHARDED'
           WHEN db IN ('brand20', 'brand21') THEN 'FLEXSHARD' ELSE 'NONSHARDED' END AS rule FROM t),
    x AS (SELECT prefix, full_name, CASE WHEN parts = 0 THEN NULL ELSE 'p' || i END AS partition, i AS ordinal, rule
      FROM q, range(0, 4) r(i) WHERE i < greatest(parts, 1)),
    m AS (SELECT *, CASE rule WHEN 'SHARDED' THEN regexp_matches(full_name, '^(?:[^.]+\\.red|.*widget_1)')
      WHEN 'FLEXSHARD' THEN regexp_matches(full_name, '^.*bolt')
      WHEN 'NONSHARDED' THEN regexp_matches(full_name, '^.*_\\d*7$') ELSE false END AS skipped,
      CASE rule WHEN 'brand3' THEN regexp_matches(full_name, '^.*_ring') WHEN 'SHARDED' THEN regexp_matches(full_name, '^.*gear')
      WHEN 'FLEXSHARD' THEN regexp_matches(full_name, '^brand2\\d\\.small') ELSE false END AS priority FROM x)
    SELECT prefix, full_name, partition, ordinal, priority FROM m WHERE NOT skipped""",
)
def select_for_export(spark, d):
    t = tables(spark, d).withColumn("n", F.col("p_size") % 4)
    positions = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))
    parts = t.select(
        F.col("db").alias("prefix"), F.concat_ws(".", "db", "table_name").alias("full_name"), "n",
        F.explode(positions).alias("position"),
    ).withColumn("partition", F.when(F.col("n") > 0, F.concat(F.lit("p"), F.col("position"))))
    return P.select_for_export(parts, RULES, ["brand1", "brand2"], ["brand20", "brand21"])


@query(
    "recent_and_ready",
    f"""SELECT event_id, CASE WHEN ts > {EVENTS_NOW} - INTERVAL 18 HOUR THEN 'recent' ELSE 'ready' END AS age
    FROM events WHERE ts > {EVENTS_NOW} - INTERVAL 21 DAY AND ts < {EVENTS_NOW}""",
)
def recent_and_ready(spark, d):
    e = load(spark, d, "events")
    fresh = in_window(F.col("ts"), EVENTS_AS_OF, newer_than=span(hours=18))
    kept = in_window(F.col("ts"), EVENTS_AS_OF, span(days=21), span())
    return e.where(kept).select("event_id", F.when(fresh, "recent").otherwise("ready").alias("age"))


@query("yesterday_rows", f"SELECT event_id FROM events WHERE CAST(ts AS DATE) = CAST({EVENTS_NOW} - INTERVAL 1 DAY AS DATE)")
def yesterday_rows(spark, d):
    e = load(spark, d, "events")
    start = F.date_trunc("day", moment(EVENTS_AS_OF)).cast("timestamp_ntz")
    return e.where((F.col("ts") >= start - span(days=1)) & (F.col("ts") < start)).select("event_id")


@query(
    "unexpected_activity",
    """SELECT h AS hostname, bool_or(act) AS active FROM (
      SELECT user_id % 97 AS h, event_type = 'error' AND value > 150 OR event_type = 'click' AND value > 200 AS act FROM events) GROUP BY 1""",
)
def unexpected_activity(spark, d):
    e = load(spark, d, "events").withColumn("hostname", F.col("user_id") % 97)
    user = F.when(F.col("value") > F.when(F.col("event_type") == "error", 150).otherwise(200), "app").otherwise("root")
    stats = e.where("event_type = 'error'").select("hostname", user.alias("user"))
    connections = e.where("event_type = 'click'").select("hostname", user.alias("user"))
    return P.unexpected_activity(stats, connections, e, ("root", "monitor"))


@query(
    "owned_hosts",
    f"""WITH inv AS (SELECT lower(c_mktsegment) || 'db-' || c_nationkey || '-' || c_custkey AS hostname, max(o_orderdate) AS launched
      FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
    pre AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'machinerydb' WHEN s_suppkey % 3 = 1 THEN 'buildingdb' ELSE 'fur' END AS prefix FROM supplier)
    SELECT hostname, launched FROM inv WHERE launched < {ORDERS_NOW} - INTERVAL 7 DAY
      AND EXISTS (SELECT 1 FROM pre WHERE starts_with(hostname, prefix))""",
)
def owned_hosts(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    name = F.concat(F.lower("c_mktsegment"), F.lit("db-"), F.col("c_nationkey"), F.lit("-"), F.col("c_custkey"))
    inventory = c.groupBy(name.alias("hostname")).agg(F.max("o_orderdate").alias("launched"))
    kind = F.col("s_suppkey") % 3
    known = load(spark, d, "supplier").select(
        F.when(kind == 0, "machinerydb-1-1").when(kind == 1, "buildingdb-2-2").otherwise("fur-3-3").alias("hostname")
    )
    return P.owned_hosts(inventory, known, moment(ORDERS_AS_OF))


@query(
    "redaction",
    """SELECT event_id, 'login ' || event_type || ' REDACTED' AS command, regexp_replace(props, '[0-9]+', 'REDACTED', 'g') AS props FROM events""",
)
def redaction(spark, d):
    e = load(spark, d, "events")
    secret = F.concat(F.lit("pw"), F.col("user_id"))
    command = F.concat(F.lit("login "), F.col("event_type"), F.lit(" "), secret)
    return e.select("event_id", redact_text(command, secret).alias("command"), redact_pattern(F.col("props"), "[0-9]+").alias("props"))


@query(
    "normalized_ddl",
    "SELECT 'CREATE TABLE ' || p_name || ' ENGINE=InnoDB DEFAULT CHARSET=latin1' AS ddl, count(*) AS n FROM part GROUP BY 1",
)
def normalized_ddl(spark, d):
    p = load(spark, d, "part")
    ddl = F.concat(
        F.lit("CREATE TABLE "), F.col("p_name"), F.lit(" ENGINE=InnoDB AUTO_INCREMENT="), F.col("p_partkey"), F.lit(" DEFAULT CHARSET=latin1")
    )
    return p.select(normalize_ddl(ddl).alias("ddl")).groupBy("ddl").agg(F.count(F.lit(1)).alias("n"))


@query("long_transactions", f"SELECT event_id, user_id, k FROM ({SQL_EVENTS}) WHERE k > 2")
def long_transactions(spark, d):
    return P.long_running(events(spark, d).select("event_id", "user_id", "k"), P.LONG_TRANSACTION_SECONDS, (), "k")


@query("long_queries", f"SELECT event_id, event_type AS \"user\", k FROM ({SQL_EVENTS}) WHERE k > 10 AND event_type NOT IN ('signup', 'view')")
def long_queries(spark, d):
    e = events(spark, d).select("event_id", F.col("event_type").alias("user"), "k")
    return P.long_running(e, P.BUSY_SECONDS, ("signup", "view"), "k")


@query(
    "partitions_of_tables",
    f"""WITH {SQL_TABLES}, p AS (SELECT DISTINCT db, table_type AS partition FROM t WHERE engine = 'InnoDB' AND p_size > 45)
    SELECT d.db, partition FROM (SELECT DISTINCT db FROM t) d LEFT JOIN p USING (db)""",
)
def partitions_of_tables(spark, d):
    t = tables(spark, d)
    named = F.when((F.col("engine") == "InnoDB") & (F.col("p_size") > 45), F.col("table_type"))
    return P.partitions_of(t, t.select("db", named.alias("partition")), ["db"])


@query(
    "partition_ordinals",
    "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal FROM part",
)
def partition_ordinals(spark, d):
    return P.partition_ordinal(load(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 512)


@query("columns_of_table", f"WITH {SQL_TABLES} SELECT p_partkey AS position, table_name AS column_name FROM t WHERE db = 'brand7' AND p_type = 'SMALL'")
def columns_of_table(spark, d):
    columns = tables(spark, d).select(
        "db", F.col("p_type").alias("table_name"), F.col("p_partkey").alias("position"), F.col("table_name").alias("column_name")
    )
    return P.columns_of(columns, "brand7", "SMALL")


@query(
    "autoincrement_info",
    f"""WITH {SQL_TABLES} SELECT db, table_name, CASE WHEN p_size % 2 = 0 THEN p_type END AS column_type,
      CASE WHEN p_size % 2 = 0 THEN p_partkey + 1 END AS next_value FROM t""",
)
def autoincrement_info(spark, d):
    t = tables(spark, d)
    columns = t.select("db", "table_name", F.col("p_type").alias("column_type"), F.when(F.col("p_size") % 2 == 0, "auto_increment").alias("extra"))
    return P.autoincrement_info(t.select("db", "table_name", (F.col("p_partkey") + 1).alias("auto_increment")), columns)


@query("min_rows_gate", "SELECT c_custkey FROM customer")
def min_rows_gate(spark, d):
    return P.min_rows_gate(load(spark, d, "customer").select("c_custkey"))
