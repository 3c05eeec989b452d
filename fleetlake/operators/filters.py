"""Row filters on schemas, tables, hosts and activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import host_prefix
from .ordered import number_slice, ordinal

# Names with a given meaning in the fleet.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "test")
ENGINES = ("InnoDB", "MyISAM")
BUSY_SECONDS = 10
JOB_QUEUE_BUSY_SECONDS = 6
LONG_TRANSACTION_SECONDS = 2
MIN_INVENTORY = 100


def user_schemas(df: DataFrame, schema: str = "schema_name", system: Sequence[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """Rows of schemas that are not the server's own."""
    return df.where(~F.col(schema).isin(*system))


def base_tables(tables: DataFrame, engines: Sequence[str] = ENGINES, views: bool = False) -> DataFrame:
    """(db, table_name, full_name) of stored tables, optionally with views."""
    kept = (F.col("table_type") == "BASE TABLE") & F.col("engine").isin(*engines)
    if views:
        kept = kept | (F.col("table_type") == "VIEW")
    return tables.where(kept).select(
        "db", "table_name", F.concat_ws(".", "db", "table_name").alias("full_name")
    )


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches at the start of the text."""
    if not patterns:
        return F.lit(False)
    return text.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def export_rules(prefix: Column, rules: dict[str, dict], sharded: Sequence[str], flex: Sequence[str]) -> Column:
    """Which rule set applies to a host prefix: its own, else that of its kind of data."""
    own = [p for p in rules if p not in ("SHARDED", "FLEXSHARD", "NONSHARDED")]
    return (
        F.when(prefix.isin(*own), prefix)
        .when(prefix.isin(*sharded), F.lit("SHARDED"))
        .when(prefix.isin(*flex), F.lit("FLEXSHARD"))
        .otherwise(F.lit("NONSHARDED"))
    )


def select_for_export(
    parts: DataFrame,
    rules: dict[str, dict],
    sharded: Sequence[str] = (),
    flex: Sequence[str] = (),
    part_slice: int = 10_000,
) -> DataFrame:
    """(prefix, full_name, partition, ordinal, priority) of what to export.

    ``parts`` has prefix, full_name, partition and position, one row per partition and one
    with a null partition for a plain table. The rules are a short configuration, so they
    become column expressions: no join. A table that any skip pattern matches is left out, the
    first priority match promotes it.
    """
    name, kind = F.col("full_name"), F.col("__rules")
    chosen = parts.withColumn("__rules", export_rules(F.col("prefix"), rules, sharded, flex))
    skipped, promoted = F.lit(False), F.lit(False)
    for key, rule in rules.items():
        skipped = F.when(kind == key, matches_any(name, rule["skipped_tables"])).otherwise(skipped)
        promoted = F.when(kind == key, matches_any(name, rule["priority_tables"])).otherwise(promoted)
    kept = chosen.where(~skipped).withColumn("priority", promoted)
    numbered = partition_ordinal(kept, ["prefix", "full_name"], "position", part_slice)
    return numbered.select("prefix", "full_name", "partition", "ordinal", "priority")


def partition_ordinal(parts: DataFrame, keys: Sequence[str], position: str, slice_width: int = 10_000) -> DataFrame:
    """Number a table's partitions from 0 in listing order."""
    return ordinal(parts, keys, [position], number_slice(position, slice_width), "ordinal")


def partitions_of(tables: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct partition names per table, or one null row for a table without partitions."""
    named = parts.where(F.col("partition").isNotNull()).select(*keys, "partition").distinct()
    return tables.select(*keys).distinct().join(named, list(keys), "left")


def columns_of(columns: DataFrame, db: str, table: str) -> DataFrame:
    """Column names of one table, with their positions."""
    return columns.where((F.col("db") == db) & (F.col("table_name") == table)).select("position", "column_name")


def autoincrement_info(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(db, table_name, column_type, next_value) per table; nulls where nothing increments."""
    auto = columns.where(F.col("extra") == "auto_increment").select("db", "table_name", "column_type")
    joined = tables.join(auto, ["db", "table_name"], "left")
    next_value = F.when(F.col("column_type").isNotNull(), F.col("auto_increment"))
    return joined.select("db", "table_name", "column_type", next_value.alias("next_value"))


def unexpected_activity(
    stats: DataFrame, connections: DataFrame, hosts: DataFrame, ignore: Sequence[str]
) -> DataFrame:
    """(hostname, active): whether anyone outside the ignore list has activity or a connection."""
    users = stats.select("hostname", "user").unionByName(connections.select("hostname", "user"))
    seen = users.where(~F.col("user").isin(*ignore)).select("hostname").distinct()
    marked = hosts.select("hostname").distinct().join(seen.withColumn("s", F.lit(True)), "hostname", "left")
    return marked.select("hostname", F.coalesce("s", F.lit(False)).alias("active"))


def owned_hosts(
    inventory: DataFrame, discovered: DataFrame, as_of: Column, weeks: int = 1, host: str = "hostname"
) -> DataFrame:
    """Inventory rows older than ``weeks`` whose name begins with a known prefix.

    Names are cut into their own beginnings and joined on equality, name by distinct name:
    host names are short, and a test of every name against every prefix is avoided.
    """
    prefixes = discovered.select(host_prefix(F.col(host)).alias("prefix")).where("prefix IS NOT NULL").distinct()
    old = inventory.where(F.col("launched") < as_of - F.make_dt_interval(F.lit(7 * weeks)))
    names = old.select(F.col(host).alias("__name")).where(F.length("__name") > 0).distinct()
    starts = F.transform(
        F.sequence(F.lit(1), F.length("__name")), lambda n: F.substring(F.col("__name"), F.lit(1), n)
    )
    known = (
        names.select("__name", F.explode(starts).alias("prefix"))
        .join(prefixes, "prefix", "left_semi")
        .select("__name")
        .distinct()
    )
    return old.join(known, old[host] == known["__name"], "left_semi")


def long_running(
    processes: DataFrame,
    seconds: int,
    ignore: Sequence[str],
    age: str = "age_seconds",
) -> DataFrame:
    """Sessions older than the limit, except those of users allowed to run long."""
    kept = F.col(age) > seconds
    return processes.where(kept & ~F.col("user").isin(*ignore) if ignore else kept)


def min_rows_gate(df: DataFrame, n: int = MIN_INVENTORY, message: str = "inventory returned too few results") -> DataFrame:
    """The same rows, or an error when there are fewer than ``n``.

    The count is a scalar subquery, so it is taken before any row is passed on.
    """
    enough = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") >= n, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    )
    return df.where(enough.scalar())
