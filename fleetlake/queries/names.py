"""Column expressions: names, stamps, escapes and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hosts as H
from ..functions import moments as M
from ..functions import text as X
from ..registry import query
from ..session import load
from .common import SQL_EVENTS, cents, events, sql_cents


@query(
    "host_parts",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'single' ELSE 'sharddb-' || l_suppkey || '-' || l_linenumber END AS hostname,
      CASE WHEN l_partkey % 9 <> 0 THEN 'sharddb' END AS prefix, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS set_num,
      CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_linenumber AS VARCHAR) END AS host_id,
      CASE WHEN l_partkey % 4 = 0 THEN 3306 ELSE 3300 + l_linenumber END AS port, l_partkey % 9 <> 0 AS valid,
      CASE WHEN l_partkey % 9 <> 0 THEN 'sharddb-' || l_suppkey END AS replica_set FROM lineitem""",
)
def host_parts(spark, d):
    li = load(spark, d, "lineitem")
    name = F.when(F.col("l_partkey") % 9 == 0, "single").otherwise(F.concat(F.lit("sharddb-"), "l_suppkey", F.lit("-"), "l_linenumber"))
    domain = F.when(F.col("l_quantity") > 25, ".example.com").otherwise("")
    port = F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(":"), F.col("l_linenumber") + 3300))
    instance = F.concat(name, domain, port)
    rows = li.select("l_orderkey", "l_linenumber", H.host_parts(instance).alias("p"), H.standardized_replica_set(instance).alias("replica_set"))
    return rows.select("l_orderkey", "l_linenumber", "p.*", "replica_set")


SQL_URL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    "host_prefix",
    f"""SELECT page_id, coalesce(nullif(regexp_extract({SQL_URL_HOST}, '^(.+db)', 1), ''), nullif(regexp_extract({SQL_URL_HOST}, '^([a-z]+)', 1), '')) AS prefix FROM pages
    UNION ALL SELECT -1 - p_partkey, CASE WHEN p_size % 3 = 0 THEN 'testdb_moddb' WHEN p_size % 3 = 1 THEN 'abc' END AS prefix FROM part""",
)
def host_prefix(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    pages = load(spark, d, "pages").select("page_id", H.host_prefix(host).alias("prefix"))
    kind = F.col("p_size") % 3
    name = F.when(kind == 0, "testdb_moddb-1-2").when(kind == 1, "abc-7").otherwise("9x")
    return pages.unionByName(load(spark, d, "part").select((F.lit(-1) - F.col("p_partkey")).alias("page_id"), H.host_prefix(name).alias("prefix")))


@query(
    "backup_file_parts",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'testdb-' || o_custkey || '-7' END AS host,
      CASE WHEN o_orderstatus <> 'P' THEN 3300 + o_orderkey % 10 END AS port,
      CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS created FROM orders""",
)
def backup_file_parts(spark, d):
    o = load(spark, d, "orders")
    good = F.format_string(
        "xtrabackup/standard/testdb-%d/testdb-%d-7-%d-%s-22:34:39.xbstream", "o_custkey", "o_custkey",
        F.col("o_orderkey") % 10 + 3300, F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    path = F.when(F.col("o_orderstatus") == "P", "xtrabackup/readme.txt").otherwise(good)
    return o.select("o_orderkey", H.backup_file_parts(path).alias("p")).select("o_orderkey", "p.*")


@query(
    "backup_keys",
    """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'xtrabackup/initial_build/db-' || user_id || '-1-3306-' || strftime(ts, '%Y-%m-%d-%H:%M:%S') || '.xbstream'
      ELSE 'xtrabackup/standard/rs-' || user_id || '/db-' || user_id || '-1-3306-' || strftime(ts, '%Y-%m-%d-%H:%M:%S') || '.xbstream' END AS key FROM events""",
)
def backup_keys(spark, d):
    e = load(spark, d, "events")
    replica_set = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("rs-"), F.col("user_id")))
    host = F.concat(F.lit("db-"), F.col("user_id"), F.lit("-1"))
    key = H.backup_key("xtrabackup", F.lit("standard"), replica_set, host, F.lit(3306), F.col("ts"))
    return e.select("event_id", key.alias("key"))


@query(
    "table_file_parts",
    """SELECT p_partkey, replace(p_name, ' ', '_') AS "table", CASE WHEN p_size % 2 = 0 THEN 'p' || p_size ELSE '' END AS partition FROM part""",
)
def table_file_parts(spark, d):
    p = load(spark, d, "part")
    suffix = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("#P#p"), F.col("p_size"))).otherwise("")
    path = F.concat(F.lit("/data/db1/"), F.replace("p_name", F.lit(" "), F.lit("_")), suffix, F.lit(".ibd"))
    return p.select("p_partkey", H.table_file_parts(path).alias("p")).select("p_partkey", "p.*")


@query(
    "namespace_of_schema",
    """SELECT event_id, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'moddb_' || event_type ELSE 'moddb_default' END AS namespace FROM events""",
)
def namespace_of_schema(spark, d):
    e = load(spark, d, "events")
    kind = F.col("user_id") % 3
    schema = F.when(kind == 0, "mysql").when(kind == 1, F.concat(F.lit("zen_"), "event_type", F.lit("_"), "user_id")).otherwise(F.concat(F.lit("pb"), "user_id"))
    return e.select("event_id", H.namespace_of_schema(schema, F.lit("moddb-12-3")).alias("namespace"))


@query(
    "ipv4_number",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 49 THEN 10 * 16777216 + (l_orderkey % 256) * 65536 + (l_partkey % 256) * 256 + l_suppkey % 256 END AS server_id FROM lineitem""",
)
def ipv4_number(spark, d):
    li = load(spark, d, "lineitem")
    good = F.concat_ws(".", F.lit("10"), *[(F.col(c) % 256).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    address = F.when(F.col("l_quantity") < 49, good).otherwise("no address")
    return li.select("l_orderkey", "l_linenumber", H.ipv4_number(address).alias("server_id"))


@query(
    "shard_type_parts",
    """SELECT c_custkey, lower(c_mktsegment) AS service, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'ns' || c_nationkey END AS namespace,
      lower(c_mktsegment) || CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE '_ns' || c_nationkey END AS shard_type FROM customer""",
)
def shard_type_parts(spark, d):
    c = load(spark, d, "customer")
    kind = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("_ns"), "c_nationkey")))
    parts = c.select("c_custkey", H.shard_type_parts(kind).alias("p")).select("c_custkey", "p.*")
    return parts.withColumn("shard_type", H.shard_type_of(F.col("service"), F.col("namespace")))


@query("pair_identity", "SELECT doc_id, md5(source || text) AS identity FROM documents")
def pair_identity(spark, d):
    return load(spark, d, "documents").select("doc_id", H.pair_identity(F.col("source"), F.col("text")).alias("identity"))


@query(
    "parsed_grants",
    """SELECT c_custkey, CASE c_nationkey % 2 WHEN 0 THEN 'SELECT, INSERT' ELSE 'ALL PRIVILEGES' END AS privileges, 'user' || c_custkey AS username,
      CASE WHEN c_custkey % 3 = 0 THEN '%' ELSE '10.%' END AS source_host, CASE WHEN c_acctbal < 1000 THEN 'NONE' ELSE '*AB' || c_custkey END AS hashed_password,
      c_custkey % 5 = 0 AS grant_option FROM customer""",
)
def parsed_grants(spark, d):
    return grants(load(spark, d, "customer")).select("c_custkey", "g.*")


def grants(c):
    """Customers as accounts, each with its GRANT statement parsed."""
    text = F.concat(
        F.lit("GRANT "), F.when(F.col("c_nationkey") % 2 == 0, "SELECT, INSERT").otherwise("ALL PRIVILEGES"),
        F.lit(" ON *.* TO 'user"), F.col("c_custkey"), F.lit("'@'"), F.when(F.col("c_custkey") % 3 == 0, "%").otherwise("10.%"), F.lit("'"),
        F.when(F.col("c_acctbal") < 1000, "").otherwise(F.concat(F.lit(" IDENTIFIED BY PASSWORD '*AB"), F.col("c_custkey"), F.lit("'"))),
        F.when(F.col("c_custkey") % 5 == 0, " WITH GRANT OPTION").otherwise(""),
    )
    return c.withColumn("g", H.parse_grant(text))


@query(
    "heartbeat_gate",
    """SELECT event_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'wait' WHEN CAST(ts AS DATE) > DATE '2024-01-15' THEN 'error' ELSE 'ok' END AS verdict FROM events""",
)
def heartbeat_gate(spark, d):
    e = load(spark, d, "events")
    beat = M.heartbeat_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return e.select("event_id", M.heartbeat_gate(beat, M.moment("2024-01-15 03:00:00")).alias("verdict"))


@query(
    "export_gate",
    f"""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'check' WHEN CAST(ts AS TIME) < TIME '00:15:00' THEN 'too_early'
      WHEN CAST(ts AS TIME) < TIME '02:30:00' AND event_type = 'click' THEN 'running' ELSE 'check' END AS verdict FROM ({SQL_EVENTS})""",
)
def export_gate(spark, d):
    e = events(spark, d)
    date = F.when(F.col("k") % 3 == 0, F.to_date("ts")).otherwise(F.date_sub(F.to_date("ts"), 1))
    return e.select("event_id", M.export_gate(date, F.col("ts"), F.col("event_type") == "click").alias("verdict"))


@query("whole_mb", f"SELECT o_orderkey, {sql_cents('o_totalprice')} // 1048576 AS mb FROM orders")
def whole_mb(spark, d):
    return load(spark, d, "orders").select("o_orderkey", X.whole_mb(cents("o_totalprice")).alias("mb"))


@query(
    "null_escapes",
    r"""SELECT doc_id, md5('a' || chr(92) || chr(92) || '0' || text) AS even_run, strlen(text) + 5 AS odd_run_bytes FROM documents""",
)
def null_escapes(spark, d):
    doc = load(spark, d, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), X.ONE_BYTE).alias("t"))
    even = F.encode(X.null_escape(F.concat(F.lit("a\\\\0"), F.col("t"))), X.ONE_BYTE)
    odd = F.encode(X.null_escape(F.concat(F.lit("ab\\\\\\0"), F.col("t"))), X.ONE_BYTE)
    return doc.select("doc_id", F.md5(even).alias("even_run"), F.octet_length(odd).cast("long").alias("odd_run_bytes"))


@query(
    "json_round_trip",
    f"SELECT event_id, k, event_type, amount FROM ({SQL_EVENTS})",
)
def json_round_trip(spark, d):
    e = events(spark, d)
    doc = F.to_json(F.struct("k", "event_type", "amount"))
    parsed = F.from_json(doc, "struct<k: bigint, event_type: string, amount: bigint>")
    return e.select("event_id", parsed.alias("p")).select("event_id", "p.*")
