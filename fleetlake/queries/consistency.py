"""Replica consistency: chunk checksums, row differences, latest reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as C
from ..operators.ordered import number_slice
from ..plans.consistency import audit, audit_rows
from ..registry import query
from ..session import load
from .common import cents, events, sql_cents, SQL_EVENTS

CHUNK_ROWS = 1000
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "day", "o_orderpriority"]


SQL_ROW_DIFF = """
    SELECT coalesce(s.o_orderkey, r.o_orderkey) AS o_orderkey,
      CASE WHEN r.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'delete'
           ELSE 'update' END AS change
    FROM {src} s FULL JOIN {rep} r ON s.o_orderkey = r.o_orderkey
    WHERE r.o_orderkey IS NULL OR s.o_orderkey IS NULL OR
      (s.o_custkey, s.o_orderstatus, s.price, s.day, s.o_orderpriority) IS DISTINCT FROM
      (r.o_custkey, r.o_orderstatus, r.price, r.day, r.o_orderpriority)"""


def chunk_of():
    return number_slice("o_orderkey", CHUNK_ROWS)


def orders(spark, d):
    """Orders, some with texts that a careless checksum mixes up: a ``#`` at a field's end, and nulls."""
    key = F.col("o_orderkey")
    day, priority = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")
    return load(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        cents("o_totalprice").alias("price"),
        F.when(key % 977 == 4, F.concat(day, F.lit("#x"))).otherwise(day).alias("day"),
        F.when(key % 971 != 5, priority).alias("o_orderpriority"),
    )


def drifted(source, damaged_below):
    """A replica of orders that lost, changed and gained rows among keys below a bound."""
    key = F.col("o_orderkey")
    low = key < damaged_below
    kept = source.where(~(low & (key % 997 == 1)))
    moved, filled = low & (key % 977 == 4), low & (key % 971 == 5)
    changed = kept.withColumns(
        {
            "price": F.when(low & (key % 991 == 2), F.col("price") + 1).otherwise(F.col("price")),
            "day": F.when(moved, F.replace("day", F.lit("#x"), F.lit(""))).otherwise(F.col("day")),
            "o_orderpriority": F.when(moved, F.concat(F.lit("x#"), "o_orderpriority"))
            .when(filled, F.lit(r"\N"))
            .otherwise(F.col("o_orderpriority")),
        }
    )
    gained = source.where(low & (key % 983 == 3)).withColumn("o_orderkey", key + 1_000_000_000)
    return changed.unionByName(gained)


def sql_replica(damaged_below):
    return f"""
    src AS (
      SELECT o_orderkey, o_custkey, o_orderstatus, {sql_cents('o_totalprice')} AS price,
             strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 977 = 4 THEN '#x' ELSE '' END AS day,
             CASE WHEN o_orderkey % 971 <> 5 THEN o_orderpriority END AS o_orderpriority FROM orders),
    rep AS (
      SELECT o_orderkey, o_custkey, o_orderstatus,
             CASE WHEN o_orderkey < {damaged_below} AND o_orderkey % 991 = 2 THEN price + 1 ELSE price END AS price,
             CASE WHEN o_orderkey < {damaged_below} THEN replace(day, '#x', '') ELSE day END AS day,
             CASE WHEN o_orderkey < {damaged_below} AND o_orderkey % 977 = 4 THEN 'x#' || o_orderpriority
                  WHEN o_orderkey < {damaged_below} AND o_orderkey % 971 = 5 THEN '\\N'
                  ELSE o_orderpriority END AS o_orderpriority
      FROM src WHERE NOT (o_orderkey < {damaged_below} AND o_orderkey % 997 = 1)
      UNION ALL
      SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, price, day, o_orderpriority
      FROM src WHERE o_orderkey < {damaged_below} AND o_orderkey % 983 = 3)"""


def sql_chunk_diff(damaged_below):
    """Chunks that differ, by comparing their rows, not by a checksum."""
    return f"""
    WITH {sql_replica(damaged_below)},
    a AS (SELECT o_orderkey // {CHUNK_ROWS} AS chunk, count(*) AS cnt FROM src GROUP BY 1),
    b AS (SELECT o_orderkey // {CHUNK_ROWS} AS chunk, count(*) AS cnt FROM rep GROUP BY 1),
    rows_that_differ AS ({SQL_ROW_DIFF.format(src='src', rep='rep')}),
    chunks AS (
      SELECT coalesce(a.chunk, b.chunk) AS chunk, coalesce(a.cnt, 0) AS master_cnt, coalesce(b.cnt, 0) AS this_cnt,
        coalesce(a.chunk, b.chunk) IN (SELECT o_orderkey // {CHUNK_ROWS} FROM rows_that_differ) AS differs
      FROM a FULL JOIN b ON a.chunk = b.chunk)"""


EVERYWHERE = 1 << 40
# Damage confined to the first chunks, so that the row check opens.
NARROW = 1200


@query("chunk_diff", sql_chunk_diff(EVERYWHERE) + " SELECT * FROM chunks")
def chunk_diff(spark, d):
    source = orders(spark, d)
    chunks = C.chunk_diff(source, drifted(source, EVERYWHERE), chunk_of(), COLUMNS)
    return chunks.select("chunk", "master_cnt", "this_cnt", "differs")


@query(
    "row_diff",
    f"WITH {sql_replica(EVERYWHERE)} {SQL_ROW_DIFF.format(src='src', rep='rep')}",
)
def row_diff(spark, d):
    source = orders(spark, d)
    return C.row_diff(source, drifted(source, EVERYWHERE), ["o_orderkey"], COLUMNS)


@query(
    "row_diff_of_suspect_chunks",
    f"""{sql_chunk_diff(NARROW)},
    bad AS (SELECT chunk FROM chunks WHERE differs),
    s2 AS (SELECT * FROM src WHERE o_orderkey // {CHUNK_ROWS} IN (SELECT chunk FROM bad)),
    r2 AS (SELECT * FROM rep WHERE o_orderkey // {CHUNK_ROWS} IN (SELECT chunk FROM bad))
    {SQL_ROW_DIFF.format(src='s2', rep='r2')}""",
)
def row_diff_of_suspect_chunks(spark, d):
    source = orders(spark, d)
    return audit_rows(source, drifted(source, NARROW), ["o_orderkey"], COLUMNS, chunk_of())[1]


def _sql_audit(damaged_below):
    return f"""{sql_chunk_diff(damaged_below)},
    n AS (SELECT count(*) AS chunk_count, CAST(sum(master_cnt) AS BIGINT) AS row_count,
                 count(*) FILTER (WHERE differs) AS chunk_diffs FROM chunks),
    kinds AS (SELECT count(*) AS row_diffs, count(*) FILTER (WHERE change = 'insert') AS rows_to_insert,
      count(*) FILTER (WHERE change = 'delete') AS rows_to_delete,
      count(*) FILTER (WHERE change = 'update') AS rows_to_update FROM rows_that_differ)
    SELECT n.*, 0 AS chunk_errors, 0 AS chunk_skips, kinds.*,
      CASE WHEN chunk_diffs > 0 THEN 'YES' ELSE 'NO' END AS rows_checked,
      CASE WHEN chunk_diffs = 0 THEN 'GOOD' WHEN chunk_diffs > 5 THEN 'TOO_MANY_CHUNK_DIFFS'
           ELSE 'ROW_DIFFS_FOUND' END AS checksum_status,
      'shard' AS db, 'orders' AS tbl, 'replica' AS instance, 'master' AS master_instance
    FROM n, kinds"""


LABELS = {"db": "shard", "tbl": "orders", "instance": "replica", "master_instance": "master"}


@query("consistency_audit", _sql_audit(NARROW))
def consistency_audit(spark, d):
    source = orders(spark, d)
    return audit(source, drifted(source, NARROW), ["o_orderkey"], COLUMNS, chunk_of(), labels=LABELS)


@query("consistency_audit_many_diffs", _sql_audit(EVERYWHERE))
def consistency_audit_many_diffs(spark, d):
    source = orders(spark, d)
    return audit(source, drifted(source, EVERYWHERE), ["o_orderkey"], COLUMNS, chunk_of(), labels=LABELS)


@query(
    "chunk_summary",
    f"""{sql_chunk_diff(EVERYWHERE)}
    SELECT 'db' || (chunk % 3) AS db, 'orders' AS tbl, count(*) AS chunk_count,
      count(*) FILTER (WHERE differs) AS chunk_diffs,
      CAST(sum(master_cnt * 10 + this_cnt) AS BIGINT) AS elapsed_time_ms
    FROM chunks GROUP BY 1""",
)
def chunk_summary(spark, d):
    source = orders(spark, d)
    chunks = C.chunk_diff(source, drifted(source, EVERYWHERE), chunk_of(), COLUMNS)
    seconds = ((F.col("master_cnt") * 10 + F.col("this_cnt")).cast("decimal(18,3)") / 1000).cast("decimal(18,3)")
    return C.chunk_summary(
        chunks.select(
            F.concat(F.lit("db"), F.pmod("chunk", F.lit(3))).alias("db"),
            F.lit("orders").alias("tbl"),
            "master_cnt", "this_cnt", "master_crc", "this_crc",
            seconds.alias("chunk_time"),
        )
    )


@query(
    "rotating_sample",
    """SELECT p_partkey, p_name FROM part
    WHERE CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 10 = dayofyear(DATE '2024-04-05') % 10""",
)
def rotating_sample(spark, d):
    parts = load(spark, d, "part").select("p_partkey", "p_name")
    return C.rotating_sample(parts, "p_name", 10, F.lit("2024-04-05").cast("date"))


def detail(spark, d):
    """Comparison results made from events: one report per event, several a day."""
    e = events(spark, d)
    diffs, skips = F.col("k") % 8, F.floor(F.col("k") / 8) % 2
    errors = F.when(F.col("k") == 99, 1).otherwise(0)
    return e.select(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("reported_at"),
        F.concat(F.lit("host-"), F.col("user_id") % 40).alias("instance"),
        F.concat(F.lit("host-"), F.col("user_id") % 4).alias("master_instance"),
        F.lit("db").alias("db"),
        F.col("event_type").alias("tbl"),
        F.when(C.rows_are_checked(errors, diffs, skips), "YES").otherwise("NO").alias("rows_checked"),
        (F.col("event_id") % 3).alias("row_diffs"),
        C.checksum_status(errors, diffs, skips).alias("checksum_status"),
    )


SQL_DETAIL = f"""
    e AS (SELECT *, k % 8 AS diffs, (k // 8) % 2 AS skips, CASE WHEN k = 99 THEN 1 ELSE 0 END AS errors
          FROM ({SQL_EVENTS})),
    detail AS (SELECT date_trunc('day', ts) AS reported_at, 'host-' || (user_id % 40) AS instance,
      'host-' || (user_id % 4) AS master_instance, 'db' AS db, event_type AS tbl,
      CASE WHEN errors <= 0 AND diffs + skips BETWEEN 1 AND 5 THEN 'YES' ELSE 'NO' END AS rows_checked,
      event_id % 3 AS row_diffs,
      CASE WHEN errors > 0 THEN 'ERRORS_IN_CHECKSUM_PROCESS' WHEN diffs + skips = 0 THEN 'GOOD'
           WHEN diffs + skips > 5 THEN 'TOO_MANY_CHUNK_DIFFS'
           WHEN diffs > 0 THEN 'ROW_DIFFS_FOUND' ELSE 'CHUNKS_WERE_SKIPPED' END AS checksum_status
      FROM e)"""


@query("checksum_status", f"WITH {SQL_DETAIL} SELECT checksum_status, rows_checked, count(*) AS n FROM detail GROUP BY ALL")
def checksum_status(spark, d):
    return detail(spark, d).groupBy("checksum_status", "rows_checked").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latest_consistency_report",
    f"""WITH {SQL_DETAIL}
    SELECT * REPLACE (CASE WHEN checksum_status = 'ROW_DIFFS_FOUND' AND rows_checked = 'YES' AND row_diffs = 0
                           THEN 'GOOD' ELSE checksum_status END AS checksum_status)
    FROM detail
    QUALIFY rank() OVER (PARTITION BY master_instance, instance, db, tbl ORDER BY reported_at DESC) = 1""",
)
def latest_consistency_report(spark, d):
    return C.latest_reports(detail(spark, d))
