"""Dumps, listings, markers and text sinks: written to the shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import moment
from ..operators import reconcile as R
from ..plans.export import export_run
from ..registry import query
from ..session import load, scratch
from ..sinks import export as E
from ..sinks import files as W
from ..sinks.upsert import KeyedTable
from ..sources import listing as L
from ..sources import records as S
from ..sources.fleet import read_fleet_table
from ..operators.mining import substring_freq
from .common import SQL_EVENTS, events
from .ordered import SQL_UPSERT, sizes
from .reconcile import SQL_EXPORT, export_inputs

RUN_AT = "2024-01-31 03:00:00"


def dumped(spark, df, part=None, compression="none"):
    root = scratch(spark, "dump")
    E.export_table(df, root, "sharddb", "db1", "t", moment(RUN_AT), part, compression)
    return root


@query("dump_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def dump_round_trip(spark, d):
    doc = load(spark, d, "documents")
    # Ranges below the default, so that a file of this size is cut.
    return S.read_dump(spark, dumped(spark, doc), doc.schema, range_bytes=4 * 1024 * 1024)


@query(
    "dump_of_escapes",
    """SELECT page_id, url || chr(9) || 'x' || chr(92) AS url, CASE WHEN page_id % 3 = 0 THEN NULL ELSE html || chr(10) || chr(92) || chr(92) || chr(10) END AS html,
      page_id % 2 = 0 AS flag, md5(html) AS blob_md5 FROM pages""",
)
def dump_of_escapes(spark, d):
    p = load(spark, d, "pages")
    rows = p.select(
        "page_id",
        F.concat("url", F.lit("\tx\\")).alias("url"),
        F.when(F.col("page_id") % 3 != 0, F.concat("html", F.lit("\n\\\\\n"))).alias("html"),
        (F.col("page_id") % 2 == 0).alias("flag"),
        F.encode("html", "UTF-8").alias("blob"),
    )
    back = S.read_dump(spark, dumped(spark, rows), rows.schema, range_bytes=64 * 1024)
    return back.withColumn("blob_md5", F.md5("blob")).drop("blob")


@query("compressed_dump", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, o_orderpriority FROM orders")
def compressed_dump(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    return S.read_dump(spark, dumped(spark, o, F.col("o_orderkey") % 4, "gzip"), o.schema)


def write_in_order(rows, root, folder, *order):
    """The column ``value`` as text, a folder per value of ``folder``, whose files in the order of their names are in order.

    A folder's rows are dealt to several tasks, as many in all as the input was read by, or more.
    """
    keys = [folder, *order]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    ordered.select(folder, "value").write.partitionBy(folder).text(root)


@query(
    "numbered_lines",
    """SELECT lang, line_no - min(line_no) OVER (PARTITION BY lang) AS line_no, md5(line) AS line_md5 FROM (
      SELECT lang, line, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) AS line_no FROM (
        SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))""",
)
def numbered_lines(spark, d):
    doc = load(spark, d, "documents")
    root = scratch(spark, "lines")
    # One text per language, in document order, so that line numbers are known.
    write_in_order(doc.select("lang", "doc_id", F.col("text").alias("value")), root, "lang", "doc_id")
    lines = S.number_lines(S.read_lines(spark, root, range_bytes=200 * 1024), by_folder=True)
    return lines.select(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "line_no", F.md5("line").alias("line_md5"))


@query(
    "zipped_lines",
    """WITH n AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS line_no, replace(text, chr(10), ' ') AS line
          FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT line_no, a.line AS a, b.line AS b FROM n a JOIN n b USING (line_no) WHERE a.role = 'user' AND b.role = 'assistant'""",
)
def zipped_lines(spark, d):
    c = load(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    root = scratch(spark, "zip")
    rows = c.select("role", "conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    write_in_order(rows, root, "role", "conv_id", "turn")
    sides = [S.number_lines(S.read_lines(spark, f"{root}/role={r}"), by_folder=True) for r in ("user", "assistant")]
    return S.zip_lines(*sides)


@query("listing", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority, true AS filled FROM orders")
def listing(spark, d):
    """Orders written to a folder per status and priority, and found again by name, unread."""
    root = scratch(spark, "listed")
    folders = ["o_orderstatus", "o_orderpriority"]
    load(spark, d, "orders").select(*folders, "o_orderkey").write.partitionBy(*folders).parquet(root)
    found = L.read_listing(spark, root, "*.parquet")
    status, priority = (F.url_decode(F.regexp_extract("path", f"/{c}=([^/]*)/", 1)) for c in folders)
    return found.groupBy(status.alias("status"), priority.alias("priority")).agg((F.min("size") > 0).alias("filled"))


@query(
    "listing_filters",
    f"""SELECT event_id, amount > 5000 AS backup, amount > 0 AS export, amount = 0 AND user_id % 2 = 0 AS garbage FROM ({SQL_EVENTS}) WHERE k >= 5
    UNION ALL SELECT event_id, false, false, user_id % 2 = 0 FROM ({SQL_EVENTS}) WHERE k < 5""",
)
def listing_filters(spark, d):
    e = events(spark, d)
    name = F.when(F.col("user_id") % 2 == 0, "part.gz").otherwise("_SUCCESS")
    objects = e.select("event_id", F.concat(F.lit("a/"), F.col("event_id"), F.lit("/"), name).alias("path"), F.when(F.col("k") < 5, 0).otherwise(F.col("amount")).alias("size"))

    flagged = objects.select("event_id")
    for flag, rows in (("backup", L.valid_backups(objects, 5000)), ("export", L.valid_exports(objects)), ("garbage", L.garbage_objects(objects))):
        flagged = R.exists_in(flagged, rows, ["event_id"], flag)
    return flagged


@query("fleet_table", "SELECT instance, o_orderkey, o_totalprice FROM orders, (VALUES ('db-1-1:3306'), ('db-2-1:3306')) i(instance)")
def fleet_table(spark, d):
    path = {"path": f"{d}/orders.parquet"}
    rows = read_fleet_table(spark, {"db-1-1:3306": path, "db-2-1:3306": path}, "parquet")
    return rows.select("instance", "o_orderkey", "o_totalprice")


@query(
    "table_export",
    """SELECT CASE WHEN source = 'src3' THEN 'priority' ELSE 'normal' END AS kind, doc_id, text, lang, source, n_chars FROM documents WHERE source <> 'src5'""",
)
def table_export(spark, d):
    doc = load(spark, d, "documents")
    rules = {"NONSHARDED": {"skipped_tables": [r"docs\.src5$"], "priority_tables": [r"docs\.src3$"]}}
    root = scratch(spark, "export")
    chosen = export_run(doc, root, "docs-1", "docs", "source", rules, moment(RUN_AT))
    back = S.read_dump(spark, root, doc.schema)
    kinds = chosen.select(
        F.split("full_name", r"\.")[1].alias("source"), F.when(F.col("priority"), "priority").otherwise("normal").alias("kind")
    ).distinct()
    return back.join(kinds, "source")


@query(
    "export_namespaces",
    """SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN 'rs-' || c_nationkey WHEN c_nationkey < 16 THEN 'flexdb' WHEN c_nationkey < 20 THEN 'moddb'
      ELSE 'moddb_' || lower(c_mktsegment) END AS namespace, '2001-08-01' AS dt FROM customer""",
)
def export_namespaces(spark, d):
    c = load(spark, d, "customer")
    nation = F.col("c_nationkey")
    kind = F.when(nation < 8, "unsharded").when(nation < 16, "flex").otherwise("sharded")
    prefix = F.when(nation < 16, "flexdb").otherwise("moddb")
    db = F.when(nation < 20, "shard12").otherwise(F.concat(F.lit("zen_"), F.lower("c_mktsegment"), F.lit("_12")))
    space = E.export_namespace(kind, F.concat(F.lit("rs-"), nation), prefix, db, "^zen_([a-z]+)_")
    return c.select("c_custkey", space.alias("namespace"), E.export_day(moment("2001-08-02 00:30:00")).alias("dt"))


@query(
    "export_positions",
    f"""SELECT event_type, '{{"heartbeat":"' || strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') || '","repl_positions":[{{"file":"mysql-bin.' || max_by(user_id, ts) || '","pos":' || max_by(event_id, ts) ||
      '}}],"Executed_Gtid_Set":"u:1-' || max_by(event_id, ts) || '"}}' AS value FROM events GROUP BY 1""",
)
def export_positions(spark, d):
    status = load(spark, d, "events").select(
        "event_type", F.col("ts").alias("heartbeat"), F.concat(F.lit("mysql-bin."), F.col("user_id")).alias("log"),
        F.col("event_id").alias("pos"), F.concat(F.lit("u:1-"), F.col("event_id")).alias("gtids"),
    )
    path = scratch(spark, "positions")
    E.export_position(status, path, ["event_type"])
    return spark.read.schema("value string, event_type string").text(path)


@query(
    "success_markers",
    f"""WITH {SQL_EXPORT} SELECT shard_type, table_name FROM status WHERE complete AND table_name % 2 = 1""",
)
def success_markers(spark, d):
    status = R.export_status(*export_inputs(spark, d))
    actions = R.success_markers(status, status.where("table_name % 2 = 0"))
    root = scratch(spark, "markers")
    W.write_success_markers(actions, root, ["shard_type", "table_name"])
    found = S.read_markers(spark, root)
    pattern = "shard_type=([^/]+)/table_name=([0-9]+)/_SUCCESS"
    return found.select(
        F.regexp_replace(F.regexp_extract("path", pattern, 1), "%20", " ").alias("shard_type"), F.regexp_extract("path", pattern, 2).cast("int").alias("table_name")
    )


@query("keyed_table", SQL_UPSERT.replace("DIRECTION", "DESC").replace("BY src DESC, ", "BY "))
def keyed_table(spark, d):
    target, changes = sizes(spark, d)
    table = KeyedTable(spark, scratch(spark, "keyed"), ["user_id", "day"], ["event_id"])
    table.merge(target)
    table.merge(changes)
    # Merging again, as after a failure, changes nothing.
    table.merge(target)
    return table.read()


@query(
    "metric_lines",
    f"""SELECT 'mysql.' || event_type || ' 1704067200 ' || k || ' replica_set=rs-' || user_id || ' db_type=master source=h' || event_id || ' user=u' AS value FROM ({SQL_EVENTS})""",
)
def metric_lines(spark, d):
    e = events(spark, d)
    rows = e.select(
        F.col("event_type").alias("metric"), F.lit(1704067200).alias("epoch"), F.col("k").alias("value"), F.concat(F.lit("rs-"), "user_id").alias("replica_set"),
        F.lit("master").alias("db_type"), F.create_map(F.lit("source"), F.concat(F.lit("h"), "event_id"), F.lit("user"), F.lit("u")).alias("tags"),
    )
    path = scratch(spark, "metrics")
    W.write_metrics(rows, path)
    return spark.read.text(path)


@query("atomic_write", "SELECT c_custkey, c_name FROM customer")
def atomic_write(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")
    path = scratch(spark, "atomic") + "/final"
    W.atomic_write(c, path, lambda written: written.where("c_custkey IS NULL"))
    return spark.read.parquet(path)


SQL_WORD_FREQS = "SELECT w AS substr, count(*) AS freq FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY 1"


@query("written_freqs", SQL_WORD_FREQS)
def written_freqs(spark, d):
    path = scratch(spark, "freqs")
    words = load(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("substr"))
    W.write_freqs(substring_freq(words), path)
    return spark.read.schema(T.StructType().add("substr", "string").add("freq", "long")).json(path)
