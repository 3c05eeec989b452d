"""Lookups against topology tables.

Plain equi-joins: the engine broadcasts a side only when its measured size is below the
broadcast threshold, and shuffles (splitting skewed partitions) when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import host_parts, shard_type_of, standardized_replica_set
from ..functions.text import redact_columns
from .latest import first_per_key


def with_topology(df: DataFrame, config: DataFrame) -> DataFrame:
    """Add replica_set and role of an instance (host, port); null where it is unknown."""
    known = config.select("host", "port", "replica_set", "role")
    return df.join(known, ["host", "port"], "left")


def shard_to_instance(shards: DataFrame, shard_map: DataFrame, config: DataFrame, role: str = "master") -> DataFrame:
    """Shards with their database and the instance that holds it in a role."""
    placed = shards.join(shard_map, [c for c in ("service", "namespace", "shard") if c in shards.columns])
    holders = config.where(F.col("role") == role).select("replica_set", "host", "port")
    joined = placed.join(holders, "replica_set", "left")
    return joined.withColumn("instance", F.concat_ws(":", "host", F.col("port").cast("string")))


def find_shard(wanted: DataFrame, shard_map: DataFrame) -> DataFrame:
    """(replica_set, mysqldb) with the shard mapped there: the first in name order, null if none."""
    first = first_per_key(
        shard_map,
        ["replica_set", "mysqldb"],
        [F.col("service"), F.col("namespace"), F.col("shard")],
    )
    return wanted.join(first, ["replica_set", "mysqldb"], "left")


def guess_replica_set(hosts: DataFrame, config: DataFrame, host: str = "hostname") -> DataFrame:
    """Replica set of a host by its name: that of the master with the same prefix and number."""
    masters = config.where("role = 'master'").select(
        standardized_replica_set(F.col("host")).alias("__std"),
        F.col("replica_set").alias("guessed_replica_set"),
    )
    named = hosts.withColumn("__std", standardized_replica_set(F.col(host)))
    return named.join(first_per_key(masters, ["__std"], [F.col("guessed_replica_set")]), "__std", "left").drop("__std")


def enrich_inventory(config: DataFrame, inventory: DataFrame) -> DataFrame:
    """Topology rows with zone, hardware, id and groups of the host; ``??VPC??`` stands for no groups."""
    known = inventory.select(
        F.col("hostname").alias("host"),
        "zone",
        "instance_id",
        "instance_type",
        F.coalesce(F.array_join("security_groups", ","), F.lit("??VPC??")).alias("groups"),
    )
    return config.join(known, "host", "left")


def topology_check(status: DataFrame, config: DataFrame, checks: tuple[str, ...] = ("sql", "io", "master")) -> DataFrame:
    """Replicas with problems: threads not running, or replicating from the wrong master.

    ``status`` has host, port, io_running, sql_running, master_host and master_port. A replica
    outside the topology is exempt from the master check.
    """
    masters = config.where("role = 'master'").select(
        "replica_set", F.col("host").alias("expected_host"), F.col("port").alias("expected_port")
    )
    known = with_topology(status, config).join(masters, "replica_set", "left")
    actual = F.concat_ws(":", "master_host", F.col("master_port").cast("string"))
    expected = F.concat_ws(":", "expected_host", F.col("expected_port").cast("string"))
    problems = []
    if "io" in checks:
        problems.append(F.when(F.col("io_running") != "Yes", F.lit("IO thread not running")))
    if "sql" in checks:
        problems.append(F.when(F.col("sql_running") != "Yes", F.lit("SQL thread not running")))
    if "master" in checks:
        wrong = F.col("expected_host").isNotNull() & (actual != expected)
        problems.append(
            F.when(wrong, F.concat(F.lit("Master is "), actual, F.lit(" rather than expected "), expected))
        )
    found = known.withColumn("problems", F.array_compact(F.array(*problems)))
    return found.where(F.size("problems") > 0).select(
        "host", "port", F.array_join("problems", ", ").alias("problems")
    )


def replica_set_members(config: DataFrame) -> DataFrame:
    """Topology rows with host name parts and without credentials."""
    parts = host_parts(F.col("host"))
    shown = config.withColumns({"prefix": parts["prefix"], "set_num": parts["set_num"], "host_id": parts["host_id"]})
    return redact_columns(shown)


def shard_counts(shard_map: DataFrame) -> DataFrame:
    """Number of shards per (service, namespace); one shard alone is not sharding."""
    return shard_map.groupBy("service", "namespace").agg(F.count_distinct("shard").alias("n_shards"))


def sharded_services(shard_map: DataFrame) -> DataFrame:
    """Services with a namespace of more than one shard."""
    return shard_counts(shard_map).where("n_shards > 1").select("service").distinct()


def sharded_types(shard_map: DataFrame) -> DataFrame:
    """Shard types of more than one shard."""
    kind = shard_type_of(F.col("service"), F.col("namespace"))
    return shard_counts(shard_map).where("n_shards > 1").select(kind.alias("shard_type"))


def replica_sets_of_type(shard_map: DataFrame) -> DataFrame:
    """(shard_type, replica_set) pairs."""
    kind = shard_type_of(F.col("service"), F.col("namespace"))
    return shard_map.select(kind.alias("shard_type"), "replica_set").distinct()


def shards_of_type(shard_map: DataFrame) -> DataFrame:
    """(shard_type, shard) pairs."""
    kind = shard_type_of(F.col("service"), F.col("namespace"))
    return shard_map.select(kind.alias("shard_type"), "shard").distinct()


def dbs_by_replica_set(shard_map: DataFrame, replica_sets: DataFrame, column: str = "mysqldb") -> DataFrame:
    """(replica_set, column) pairs, with one null row for a replica set that has none.

    One row per member instead of a set per replica set, so no group is collected.
    """
    pairs = shard_map.select("replica_set", column).distinct()
    return replica_sets.select("replica_set").distinct().join(pairs, "replica_set", "left")
