"""Exports with a commit, many servers as one source, statistics from file footers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import moment
from ..operators import rollups as A
from ..plans.export import checked_export
from ..registry import query
from ..session import load, qualified, scratch
from ..sinks import checked as C
from ..sources import fleet as S
from ..sources import statistics as P
from ..sources.records import _file_system
from .common import SQL_EVENTS, events

RUN_AT = "2024-01-31 03:00:00"
RULES = {"NONSHARDED": {"skipped_tables": [r"docs\.src5$"], "priority_tables": []}}


def server_status(spark, d):
    return events(spark, d).select(
        F.col("ts").alias("heartbeat"),
        F.concat(F.lit("bin."), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("log"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("u:1-"), "event_id").alias("gtids"),
    )


def exported(spark, d, compression="none"):
    """Root of an export of all documents that was run twice, the second time for good."""
    root, doc, status = scratch(spark, "checked"), load(spark, d, "documents"), server_status(spark, d)
    for rules in ({}, RULES):
        checked_export(doc, root, "docs/day", "docs-1", "docs", "source", rules, moment(RUN_AT), status, compression=compression)
    return root


@query(
    "checked_export",
    """SELECT 'docs' AS namespace, 'docs' AS db, source AS "table", '2024-01-30' AS dt, '0' AS part, doc_id, text, lang, source, n_chars
    FROM documents WHERE source <> 'src5'""",
)
def checked_export_rows(spark, d):
    return C.read_export(spark, exported(spark, d), "docs/day", range_bytes=1024 * 1024)


@query("checked_export_tables", "SELECT source AS \"table\", doc_id, n_chars FROM documents WHERE source IN ('src1', 'src3')")
def checked_export_tables(spark, d):
    rows = C.read_export(spark, exported(spark, d, "zstd"), "docs/day", ["doc_id", "n_chars"], {"table": ["src1", "src3"]})
    return rows.select("table", "doc_id", "n_chars")


@query(
    "export_commits",
    f"""WITH newest AS (SELECT ts, 'bin.' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS log, event_id AS pos FROM ({SQL_EVENTS})
      ORDER BY ts DESC, log DESC, pos DESC LIMIT 1)
    SELECT 'docs/day' AS name, 2 AS version, source AS "table", CAST(count(*) AS BIGINT) AS cnt,
      (SELECT log FROM newest) AS log, CAST((SELECT pos FROM newest) AS VARCHAR) AS pos
    FROM documents WHERE source <> 'src5' GROUP BY source""",
)
def export_commits(spark, d):
    lines = C.export_commits(spark, exported(spark, d))
    at = [F.get_json_object("position", f"$.repl_positions[0].{k}").alias(n) for k, n in (("file", "log"), ("pos", "pos"))]
    heads = lines.where("file IS NULL").select("name", *at)
    counts = lines.where("file IS NOT NULL").groupBy("name", "version", "table").agg(F.sum("rows").alias("cnt"))
    return counts.join(heads, "name")


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"]


@query("footer_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS cnt FROM {t}" for t in TABLES))
def footer_rows(spark, d):
    counted = [
        P.table_rows(P.footers(spark, f"{d}/{t}.parquet")).select(F.lit(t).alias("table_name"), F.col("rows").alias("cnt"))
        for t in TABLES
    ]
    return reduce(lambda a, b: a.unionByName(b), counted)


MEASURED = ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(
    "footer_ranges",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS cnt, count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS low,
        CAST(max({c}) AS DOUBLE) AS high FROM lineitem""" for c in MEASURED
    ),
)
def footer_ranges(spark, d):
    return P.column_ranges(P.footers(spark, f"{d}/lineitem.parquet", MEASURED)).withColumnRenamed("rows", "cnt")


@query(
    "footer_row_bounds",
    "SELECT 'l_orderkey' AS \"column\", count(*) AS cnt, true AS within FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900",
)
def footer_row_bounds(spark, d):
    bounds = P.rows_between(P.footers(spark, f"{d}/lineitem.parquet", ["l_orderkey"]), 100, 900)
    keyed = load(spark, d, "lineitem").where("l_orderkey BETWEEN 100 AND 900").select(F.lit("l_orderkey").alias("column"))
    both = bounds.join(A.table_row_counts(keyed, ["column"]), "column")
    return both.select("column", "cnt", F.col("cnt").between(F.col("at_least"), F.col("at_most")).alias("within"))


def fetch_share(instance, options):
    """The rows of one server: those orders whose customer it holds."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    system, path = _file_system(options["path"])
    number, of = pa.scalar(int(options["number"]), pa.int64()), pa.scalar(int(options["of"]), pa.int64())
    for file in ds.dataset(path, filesystem=system, format="parquet").files:
        # The scan of a data set reads ahead and holds whole row groups; this one holds a batch and a buffer per column.
        with system.open_input_file(file) as handle, pq.ParquetFile(handle, buffer_size=1 << 20, pre_buffer=False) as given:
            for batch in given.iter_batches(1 << 16, columns=["o_orderkey", "o_custkey"], use_threads=False):
                customer = pc.cast(batch.column("o_custkey"), pa.int64())
                turn = pc.subtract(customer, pc.multiply(pc.divide(customer, of), of))
                yield batch.filter(pc.equal(turn, number))


def servers(spark, d):
    """A server per number 0 to 11, of which number 7 cannot be read."""
    path = qualified(spark, f"{d}/orders.parquet")
    number = F.col("id").cast("string")
    place = F.when(F.col("id") == 7, path + "-missing").otherwise(path)
    options = F.create_map(F.lit("path"), place, F.lit("number"), number, F.lit("of"), F.lit("12"))
    return spark.range(12).select(F.concat(F.lit("db-"), number).alias("instance"), options.alias("options"))


ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType())])


@query(
    "fleet_servers",
    """SELECT 'db-' || (o_custkey % 12) AS instance, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, NULL AS error
      FROM orders WHERE o_custkey % 12 <> 7
    UNION ALL SELECT 'db-7', NULL, NULL, 'FileNotFoundError'""",
)
def fleet_servers(spark, d):
    rows = S.read_servers(servers(spark, d), fetch_share, ORDER, 12)
    return rows.withColumn("error", F.split("error", ":")[0])


@query(
    "fleet_whole_servers",
    "SELECT 'db-' || (o_custkey % 12) AS instance, count(*) AS cnt FROM orders WHERE o_custkey % 12 <> 7 GROUP BY 1",
)
def fleet_whole_servers(spark, d):
    whole = S.whole_servers(S.read_servers(servers(spark, d), fetch_share, ORDER, 12))
    return whole.groupBy("instance").agg(F.count(F.lit(1)).alias("cnt"))
