"""Fleet topology documents (JSON) as flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.latest import overlay
from ..schemas import AUTH_ROLES_JSON, REPLICA_CONFIG_JSON, SHARD_MAP_JSON

ROLES = ("master", "slave", "dr_slave")


def _replica_sets(doc: DataFrame, column: str) -> DataFrame:
    parsed = doc.select(F.from_json(column, REPLICA_CONFIG_JSON).alias("m"))
    return parsed.select(F.explode("m").alias("replica_set", "c"))


def _by_role(sets: DataFrame) -> DataFrame:
    members = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("role"), F.col(f"c.{r}").alias("at"), F.col("c.db").alias("db"))
                for r in ROLES
            ]
        )
    )
    rows = sets.select("replica_set", members.alias("x")).where("x.at IS NOT NULL")
    return rows.select("replica_set", "x.role", "x.at.host", "x.at.port", "x.db")


def read_replica_config(
    base: Sequence[DataFrame], dr: DataFrame | None = None, column: str = "doc"
) -> DataFrame:
    """(replica_set, role, host, port, db) from base documents and a disaster-recovery document.

    A replica set in several base documents comes from the last one; the disaster-recovery
    document replaces single roles.
    """
    members = _by_role(overlay([_replica_sets(b, column) for b in base], ["replica_set"]))
    if dr is None:
        return members
    replaced = _by_role(_replica_sets(dr, column))
    databases = members.select("replica_set", "db").distinct()
    replaced = replaced.drop("db").join(databases, "replica_set", "left")
    return overlay([members, replaced.select(*members.columns)], ["replica_set", "role"])


def read_shard_map(doc: DataFrame, column: str = "doc") -> DataFrame:
    """(service, namespace, shard, mysqldb, replica_set); the unnamed namespace stays empty text."""
    services = doc.select(F.explode(F.from_json(column, SHARD_MAP_JSON)["services"]).alias("service", "s"))
    spaces = services.select("service", F.explode("s.namespaces").alias("namespace", "n"))
    shards = spaces.select("service", "namespace", F.explode("n.shards").alias("shard", "x"))
    return shards.select("service", "namespace", "shard", "x.mysqldb", "x.replica_set")


def printed_namespace(namespace: Column) -> Column:
    """The unnamed namespace is shown as ``default``."""
    return F.when(namespace == "", "default").otherwise(namespace)


def read_auth_roles(doc: DataFrame, column: str = "doc") -> DataFrame:
    """(role, user, host, privileges, grant_option, enabled), one row per user and source host."""
    roles = doc.select(F.explode(F.from_json(column, AUTH_ROLES_JSON)).alias("role", "r"))
    hosts = F.coalesce(F.col("r.source_hosts"), F.array(F.lit("%")))
    rows = roles.select(
        "role",
        F.col("r.privileges").alias("privileges"),
        F.coalesce("r.grant_option", F.lit(False)).alias("grant_option"),
        F.explode("r.users").alias("u"),
        hosts.alias("hosts"),
    ).withColumn("host", F.explode("hosts"))
    return rows.select(
        "role", F.col("u.username").alias("user"), "host", "privileges", "grant_option", "u.enabled"
    )


def duplicate_accounts(accounts: DataFrame) -> DataFrame:
    """user@host pairs defined more than once, which the fleet treats as an error."""
    return accounts.groupBy("user", "host").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
