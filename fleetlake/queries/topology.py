"""Topology documents, lookups against them and set summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..registry import query
from ..session import load
from ..sources import topology as T


def config_docs(spark, d):
    """One replica configuration document per supplier."""
    s = load(spark, d, "supplier")
    name = F.concat(F.lit("sharddb-"), F.col("s_suppkey"))

    def at(number, port):
        return F.struct(
            F.concat(name, F.lit(f"-{number}")).alias("host"), (F.lit(port) + F.col("s_nationkey") % 3).alias("port")
        )

    entry = F.struct(
        F.col("s_name").alias("db"),
        F.lit("app").alias("user"),
        F.lit("secret").alias("passwd"),
        at(1, 3306).alias("master"),
        at(2, 3306).alias("slave"),
    )
    return s.select(F.to_json(F.create_map(name, entry)).alias("doc"), "s_suppkey")


def dr_docs(spark, d):
    """Disaster-recovery replicas for every third supplier."""
    s = load(spark, d, "supplier").where("s_suppkey % 3 = 0")
    name = F.concat(F.lit("sharddb-"), F.col("s_suppkey"))
    at = F.struct(F.concat(name, F.lit("-9")).alias("host"), F.lit(3307).alias("port"))
    return s.select(F.to_json(F.create_map(name, F.struct(at.alias("dr_slave")))).alias("doc"))


def newer_docs(spark, d):
    """A second base document that moves the masters of every fifth supplier."""
    s = load(spark, d, "supplier").where("s_suppkey % 5 = 0")
    name = F.concat(F.lit("sharddb-"), F.col("s_suppkey"))
    at = F.struct(F.concat(name, F.lit("-7")).alias("host"), F.lit(3306).alias("port"))
    entry = F.struct(F.lit("moved").alias("db"), at.alias("master"))
    return s.select(F.to_json(F.create_map(name, entry)).alias("doc"))


SQL_CONFIG = """
    config AS (
      SELECT 'sharddb-' || s_suppkey AS replica_set, 'master' AS role, 'sharddb-' || s_suppkey ||
        CASE WHEN s_suppkey % 5 = 0 THEN '-7' ELSE '-1' END AS host,
        CASE WHEN s_suppkey % 5 = 0 THEN 3306 ELSE 3306 + s_nationkey % 3 END AS port,
        CASE WHEN s_suppkey % 5 = 0 THEN 'moved' ELSE s_name END AS db FROM supplier
      UNION ALL
      SELECT 'sharddb-' || s_suppkey, 'slave', 'sharddb-' || s_suppkey || '-2', 3306 + s_nationkey % 3, s_name
      FROM supplier WHERE s_suppkey % 5 <> 0
      UNION ALL
      SELECT 'sharddb-' || s_suppkey, 'dr_slave', 'sharddb-' || s_suppkey || '-9', 3307,
        CASE WHEN s_suppkey % 5 = 0 THEN 'moved' ELSE s_name END FROM supplier WHERE s_suppkey % 3 = 0)"""


def config(spark, d):
    return T.read_replica_config([config_docs(spark, d), newer_docs(spark, d)], dr_docs(spark, d))


@query("replica_config", f"WITH {SQL_CONFIG} SELECT * FROM config")
def replica_config(spark, d):
    return config(spark, d)


def shard_map(spark, d):
    """Customers as shards: service by segment, namespace and replica set by nation."""
    c = load(spark, d, "customer")
    space = F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("ns"), F.col("c_nationkey")))
    shard = F.struct(
        F.concat(F.lit("db"), F.col("c_custkey") % 500).alias("mysqldb"),
        F.concat(F.lit("rs-"), F.col("c_nationkey")).alias("replica_set"),
    )
    shards = F.struct(F.create_map(F.col("c_custkey").cast("string"), shard).alias("shards"))
    spaces = F.struct(F.create_map(space, shards).alias("namespaces"))
    services = F.struct(F.create_map(F.lower("c_mktsegment"), spaces).alias("services"))
    return T.read_shard_map(c.select(F.to_json(services).alias("doc")))


SQL_SHARDS = """
    shards AS (SELECT lower(c_mktsegment) AS service,
      CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'ns' || c_nationkey END AS namespace,
      CAST(c_custkey AS VARCHAR) AS shard, 'db' || (c_custkey % 500) AS mysqldb,
      'rs-' || c_nationkey AS replica_set FROM customer)"""
SQL_KIND = "CASE WHEN namespace = '' THEN service ELSE service || '_' || namespace END"


@query("shard_map", f"WITH {SQL_SHARDS} SELECT * REPLACE (CASE WHEN namespace = '' THEN 'default' ELSE namespace END AS namespace) FROM shards")
def shard_map_rows(spark, d):
    return shard_map(spark, d).withColumn("namespace", T.printed_namespace(F.col("namespace")))


def roles(spark, d):
    c = load(spark, d, "customer")
    key = F.col("c_custkey")

    def user(name):
        return F.struct(
            F.concat(F.lit(name), key % 700).alias("username"),
            F.lit("pw").alias("password"),
            (F.col("c_acctbal") >= 0).alias("enabled"),
        )

    role = F.struct(
        F.lit("SELECT").alias("privileges"),
        F.when(key % 2 == 0, F.array(F.lit("10.%"), F.lit("localhost"))).alias("source_hosts"),
        F.when(key % 4 == 0, F.lit(True)).alias("grant_option"),
        F.array(user("a"), user("b")).alias("users"),
    )
    return c.select(F.to_json(F.create_map(F.concat(F.lit("role"), key), role)).alias("doc"))


SQL_ROLES = """
    accounts AS (SELECT 'role' || c_custkey AS role, p || (c_custkey % 700) AS "user", host, 'SELECT' AS privileges,
      c_custkey % 4 = 0 AS grant_option, c_acctbal >= 0 AS enabled
      FROM customer, (VALUES ('a'), ('b')) u(p), (VALUES ('10.%'), ('localhost'), ('%')) h(host)
      WHERE (c_custkey % 2 = 0) = (host <> '%'))"""


@query("auth_roles", f"WITH {SQL_ROLES} SELECT * FROM accounts")
def auth_roles(spark, d):
    return T.read_auth_roles(roles(spark, d))


@query("duplicate_accounts", f'WITH {SQL_ROLES} SELECT "user", host, count(*) AS n FROM accounts GROUP BY 1, 2 HAVING count(*) > 1')
def duplicate_accounts(spark, d):
    return T.duplicate_accounts(T.read_auth_roles(roles(spark, d)))


# Lookups ---------------------------------------------------------------------------------


def shipments(spark, d):
    """Line items as activity on instances; some of them on hosts nobody knows."""
    li = load(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("sharddb-"), F.col("l_suppkey"), F.lit("-"), F.col("l_linenumber")).alias("host"),
        F.lit(3306).alias("port"),
        F.col("l_quantity").cast("long").alias("qty"),
    )


@query(
    "instance_topology",
    f"""WITH {SQL_CONFIG}, li AS (SELECT 'sharddb-' || l_suppkey || '-' || l_linenumber AS host, 3306 AS port,
          CAST(l_quantity AS BIGINT) AS qty FROM lineitem)
    SELECT replica_set, role, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty
    FROM li LEFT JOIN config USING (host, port) GROUP BY ALL""",
)
def instance_topology(spark, d):
    known = L.with_topology(shipments(spark, d), config(spark, d))
    return known.groupBy("replica_set", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty")
    )


def nation_config(spark, d):
    """Masters and slaves of the replica sets that hold the customers' shards."""
    rows = load(spark, d, "supplier").select("s_nationkey").distinct()
    name = F.concat(F.lit("rs-"), F.col("s_nationkey"))
    return rows.select(
        name.alias("replica_set"),
        F.explode(F.array(F.lit("master"), F.lit("slave"))).alias("role"),
        F.col("s_nationkey"),
    ).select(
        "replica_set",
        "role",
        F.concat(F.lit("rs-"), F.col("s_nationkey"), F.when(F.col("role") == "master", "-1").otherwise("-2")).alias("host"),
        F.lit(3306).alias("port"),
    )


SQL_NATION_CONFIG = """
    nconfig AS (SELECT DISTINCT 'rs-' || s_nationkey AS replica_set, role,
      'rs-' || s_nationkey || CASE WHEN role = 'master' THEN '-1' ELSE '-2' END AS host, 3306 AS port
      FROM supplier, (VALUES ('master'), ('slave')) r(role))"""


@query(
    "shard_to_instance",
    f"""WITH {SQL_SHARDS}, {SQL_NATION_CONFIG}
    SELECT o_orderkey, mysqldb, s.replica_set, coalesce(host || ':' || port, '') AS instance
    FROM orders JOIN shards s ON s.shard = CAST(o_custkey AS VARCHAR)
    LEFT JOIN nconfig c ON c.replica_set = s.replica_set AND c.role = 'slave'""",
)
def shard_to_instance(spark, d):
    wanted = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("shard"))
    placed = L.shard_to_instance(wanted, shard_map(spark, d), nation_config(spark, d), "slave")
    return placed.select("o_orderkey", "mysqldb", "replica_set", "instance")


@query(
    "find_shard",
    f"""WITH {SQL_SHARDS}, first AS (SELECT * FROM shards QUALIFY row_number() OVER (
          PARTITION BY replica_set, mysqldb ORDER BY service, namespace, shard) = 1),
    wanted AS (SELECT DISTINCT 'rs-' || s_nationkey AS replica_set, 'db' || s_suppkey AS mysqldb FROM supplier)
    SELECT replica_set, mysqldb, service, namespace, shard FROM wanted LEFT JOIN first USING (replica_set, mysqldb)""",
)
def find_shard(spark, d):
    s = load(spark, d, "supplier")
    wanted = s.select(
        F.concat(F.lit("rs-"), F.col("s_nationkey")).alias("replica_set"),
        F.concat(F.lit("db"), F.col("s_suppkey")).alias("mysqldb"),
    ).distinct()
    return L.find_shard(wanted, shard_map(spark, d))


@query(
    "guess_replica_set",
    f"""WITH {SQL_CONFIG}, m AS (SELECT regexp_replace(host, '-[^-]+$', '') AS std, min(replica_set) AS guessed_replica_set
          FROM config WHERE role = 'master' GROUP BY 1),
    h AS (SELECT DISTINCT 'sharddb-' || (l_partkey % 150) || '-' || l_linenumber AS hostname FROM lineitem)
    SELECT hostname, guessed_replica_set FROM h LEFT JOIN m ON regexp_replace(hostname, '-[^-]+$', '') = std""",
)
def guess_replica_set(spark, d):
    li = load(spark, d, "lineitem")
    hosts = li.select(
        F.concat(F.lit("sharddb-"), F.col("l_partkey") % 150, F.lit("-"), F.col("l_linenumber")).alias("hostname")
    ).distinct()
    return L.guess_replica_set(hosts, config(spark, d))


@query(
    "enriched_inventory",
    f"""WITH {SQL_CONFIG}, inv AS (
      SELECT 'sharddb-' || s_suppkey || '-1' AS host, 'zone-' || n_regionkey AS zone, 'i-' || s_suppkey AS instance_id,
        'r3.' || (s_suppkey % 4) AS instance_type,
        CASE WHEN s_suppkey % 2 = 0 THEN 'db,' || n_name ELSE '??VPC??' END AS groups
      FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT * FROM config LEFT JOIN inv USING (host)""",
)
def enriched_inventory(spark, d):
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    inventory = s.select(
        F.concat(F.lit("sharddb-"), F.col("s_suppkey"), F.lit("-1")).alias("hostname"),
        F.concat(F.lit("zone-"), F.col("n_regionkey")).alias("zone"),
        F.concat(F.lit("i-"), F.col("s_suppkey")).alias("instance_id"),
        F.concat(F.lit("r3."), F.col("s_suppkey") % 4).alias("instance_type"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("db"), F.col("n_name"))).alias("security_groups"),
    )
    return L.enrich_inventory(config(spark, d), inventory)


@query(
    "topology_check",
    f"""WITH {SQL_CONFIG}, status AS (
      SELECT 'sharddb-' || (o_custkey % 120) || '-2' AS host, 3306 + o_custkey % 3 AS port,
        CASE WHEN o_orderstatus = 'P' THEN 'No' ELSE 'Yes' END AS io_running,
        CASE WHEN o_orderkey % 7 = 0 THEN 'No' ELSE 'Yes' END AS sql_running,
        'sharddb-' || (o_custkey % 120) || CASE WHEN o_orderkey % 2 = 0 THEN '-1' ELSE '-3' END AS master_host,
        3306 + o_custkey % 3 AS master_port FROM orders),
    j AS (SELECT s.*, c.replica_set, m.host || ':' || m.port AS expected, master_host || ':' || master_port AS actual
      FROM status s LEFT JOIN config c ON c.host = s.host AND c.port = s.port
      LEFT JOIN config m ON m.replica_set = c.replica_set AND m.role = 'master')
    SELECT host, port, concat_ws(', ', CASE WHEN io_running <> 'Yes' THEN 'IO thread not running' END,
      CASE WHEN sql_running <> 'Yes' THEN 'SQL thread not running' END,
      CASE WHEN expected IS NOT NULL AND expected <> actual
           THEN 'Master is ' || actual || ' rather than expected ' || expected END) AS problems, count(*) AS n
    FROM j WHERE io_running <> 'Yes' OR sql_running <> 'Yes' OR (expected IS NOT NULL AND expected <> actual)
    GROUP BY ALL""",
)
def topology_check(spark, d):
    o = load(spark, d, "orders")
    name = F.concat(F.lit("sharddb-"), F.col("o_custkey") % 120)
    port = (F.lit(3306) + F.col("o_custkey") % 3).cast("int")
    status = o.select(
        F.concat(name, F.lit("-2")).alias("host"),
        port.alias("port"),
        F.when(F.col("o_orderstatus") == "P", "No").otherwise("Yes").alias("io_running"),
        F.when(F.col("o_orderkey") % 7 == 0, "No").otherwise("Yes").alias("sql_running"),
        F.concat(name, F.when(F.col("o_orderkey") % 2 == 0, "-1").otherwise("-3")).alias("master_host"),
        port.alias("master_port"),
    )
    found = L.topology_check(status, config(spark, d))
    return found.groupBy("host", "port", "problems").agg(F.count(F.lit(1)).alias("n"))


@query(
    "redacted_members",
    f"""WITH {SQL_CONFIG} SELECT *, 'sharddb' AS prefix, split_part(host, '-', 2) AS set_num,
      split_part(host, '-', 3) AS host_id, 'REDACTED' AS "user", 'REDACTED' AS passwd FROM config""",
)
def redacted_members(spark, d):
    open_text = config(spark, d).withColumns({"user": F.col("db"), "passwd": F.col("host")})
    return L.replica_set_members(open_text)


# Sets ------------------------------------------------------------------------------------


@query("sharded_services", f"WITH {SQL_SHARDS}, n AS (SELECT service, namespace FROM shards GROUP BY 1, 2 HAVING count(DISTINCT shard) > 1) SELECT DISTINCT service FROM n")
def sharded_services(spark, d):
    return L.sharded_services(shard_map(spark, d))


@query("sharded_types", f"WITH {SQL_SHARDS} SELECT {SQL_KIND} AS shard_type FROM shards GROUP BY 1 HAVING count(DISTINCT shard) > 1")
def sharded_types(spark, d):
    return L.sharded_types(shard_map(spark, d))


@query("replica_sets_of_type", f"WITH {SQL_SHARDS} SELECT DISTINCT {SQL_KIND} AS shard_type, replica_set FROM shards")
def replica_sets_of_type(spark, d):
    return L.replica_sets_of_type(shard_map(spark, d))


@query("shards_of_type", f"WITH {SQL_SHARDS} SELECT DISTINCT {SQL_KIND} AS shard_type, shard FROM shards")
def shards_of_type(spark, d):
    return L.shards_of_type(shard_map(spark, d))


SQL_RS = "rs AS (SELECT DISTINCT 'rs-' || n_nationkey AS replica_set FROM nation)"


def all_replica_sets(spark, d):
    return load(spark, d, "nation").select(F.concat(F.lit("rs-"), F.col("n_nationkey")).alias("replica_set"))


@query(
    "dbs_by_replica_set",
    f"""WITH {SQL_SHARDS}, {SQL_RS}, p AS (SELECT DISTINCT replica_set, mysqldb FROM shards)
    SELECT replica_set, mysqldb FROM rs LEFT JOIN p USING (replica_set)""",
)
def dbs_by_replica_set(spark, d):
    return L.dbs_by_replica_set(shard_map(spark, d), all_replica_sets(spark, d))


@query(
    "shards_by_replica_set",
    f"""WITH {SQL_SHARDS}, {SQL_RS}, p AS (SELECT DISTINCT replica_set, shard FROM shards)
    SELECT replica_set, shard FROM rs LEFT JOIN p USING (replica_set)""",
)
def shards_by_replica_set(spark, d):
    return L.dbs_by_replica_set(shard_map(spark, d), all_replica_sets(spark, d), "shard")
