"""Counts, sums and rates per schema, table, user and instance.

All are single aggregations that combine map-side; key sets are small next to the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import backup_file_parts, namespace_of_schema
from ..functions.text import normalize_ddl

# Ages, tolerances and limits in use in the fleet.
LARGE_RESTORE_AGE = 90
ROW_ACTUAL_MAX_DIFF = 0.001
ROW_ESTIMATE_MAX_DIFF = 0.3
DISK_LIMIT = 0.65


def whole(amount: Column, by: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", amount, by if isinstance(by, Column) else F.lit(by))


def db_size(log: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """(db, size_mb, tables, ok): yesterday's logged sizes; not ok when the table count has changed.

    ``log`` has db, table_name, reported_at, size_mb; ``current`` has db, table_name.
    """
    yesterday = log.where(F.col("reported_at") == F.date_sub(F.to_date(as_of), 1))
    sizes = yesterday.groupBy("db").agg(
        F.sum("size_mb").alias("size_mb"), F.count_distinct("table_name").alias("tables")
    )
    now = current.groupBy("db").agg(F.count_distinct("table_name").alias("__now"))
    joined = sizes.join(now, "db", "left")
    ok = F.col("tables") == F.coalesce("__now", F.lit(0))
    return joined.select("db", "size_mb", "tables", ok.alias("ok"))


def approx_schema_size(tables: DataFrame) -> DataFrame:
    """Whole MB of data and indexes per schema, by the server's own estimate."""
    total = F.sum(F.col("data_length") + F.col("index_length"))
    return tables.groupBy("db").agg(whole(total, 1048576).alias("size_mb"))


def activity_by_schema(schemata: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows read and changed per schema; a schema without statistics has 0."""
    per_schema = stats.groupBy("db").agg(
        F.sum("rows_read").alias("rows_read"), F.sum("rows_changed").alias("rows_changed")
    )
    joined = schemata.select("db").distinct().join(per_schema, "db", "left")
    return joined.na.fill(0, ["rows_read", "rows_changed"])


def process_counts(processes: DataFrame) -> DataFrame:
    """Sessions by user, source host and command."""
    source = F.substring_index("host", ":", 1)
    return (
        processes.select(
            F.lower("user").alias("user"),
            F.when(F.coalesce(source, F.lit("")) == "", "unknown").otherwise(source).alias("source"),
            F.replace(F.lower("command"), F.lit(" "), F.lit("")).alias("command"),
        )
        .groupBy("user", "source", "command")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def connected_users(processes: DataFrame) -> DataFrame:
    """Distinct users with a session."""
    return processes.select("user").distinct()


def user_activity(stats: DataFrame, counters: Sequence[str], keys: Sequence[str] = ("instance", "user")) -> DataFrame:
    """All counters per user account and instance."""
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def replicas_in_sync(status: DataFrame, keys: Sequence[str] = ("replica_set",)) -> DataFrame:
    """Whether all replicas of a set are at one (log, position); one without a position is not."""
    same = (F.min("log") == F.max("log")) & (F.min("pos") == F.max("pos"))
    known = F.count_if(F.col("log").isNull() | F.col("pos").isNull()) == 0
    return status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicas"), F.coalesce(known & same, F.lit(False)).alias("in_sync")
    )


def schema_drift(definitions: DataFrame, seed: Column) -> DataFrame:
    """(hash, instance, db) of definitions that differ from the seed's once normalized."""
    hashed = definitions.withColumn("hash", F.md5(normalize_ddl(F.col("ddl")).cast("binary")))
    wanted = F.md5(normalize_ddl(seed).cast("binary"))
    return hashed.where(F.col("hash") != wanted).select("hash", "instance", "db").distinct()


def restore_age(log: DataFrame, replica_sets: DataFrame, as_of: Column, unreachable: DataFrame | None = None) -> DataFrame:
    """Days since the backup that was last restored with success was taken.

    Only restores finished in the last 90 days count; without one the age is 90. Replica sets
    that could not be asked are given 0.
    """
    recent = log.where(
        (F.col("restore_status") == "OK")
        & (F.col("finished_at") > as_of - F.make_dt_interval(F.lit(LARGE_RESTORE_AGE)))
    )
    last = recent.groupBy("replica_set").agg(
        F.max_by("restore_file", F.struct("finished_at", "restore_file")).alias("file")
    )
    taken = backup_file_parts(F.col("file"))["created"]
    age = F.coalesce(F.datediff(F.to_date(as_of), taken), F.lit(LARGE_RESTORE_AGE))
    ages = replica_sets.select("replica_set").distinct().join(last, "replica_set", "left")
    if unreachable is None:
        return ages.select("replica_set", age.alias("age"))
    down = unreachable.select("replica_set").distinct().withColumn("__down", F.lit(True))
    return ages.join(down, "replica_set", "left").select(
        "replica_set", F.when(F.col("__down"), 0).otherwise(age).alias("age")
    )


def row_count_check(source: DataFrame, destination: DataFrame, exact: bool = True) -> DataFrame:
    """Tables whose destination count lies outside the tolerance around the source count.

    Both sides have db, table_name and cnt; a table absent on one side counts 0 there.
    """
    tolerance = ROW_ACTUAL_MAX_DIFF if exact else ROW_ESTIMATE_MAX_DIFF
    keys = ["db", "table_name"]
    both = source.select(*keys, F.col("cnt").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        destination.select(*keys, F.lit(0).cast("long").alias("s"), F.col("cnt").alias("t"))
    )
    counts = both.groupBy(*keys).agg(F.sum("s").alias("source_cnt"), F.sum("t").alias("destination_cnt"))
    problem = F.when(F.col("source_cnt") * (1 + tolerance) < F.col("destination_cnt"), "too large").when(
        F.col("source_cnt") * (1 - tolerance) > F.col("destination_cnt"), "too small"
    )
    return counts.withColumn("problem", problem).where("problem IS NOT NULL")


def required_space(dbs: DataFrame, logged: DataFrame, estimates: DataFrame, by: Sequence[str]) -> DataFrame:
    """MB needed for the databases to move: the logged size, else the estimate."""
    sized = dbs.join(logged.select("db", F.col("size_mb").alias("l")), "db", "left").join(
        estimates.select("db", F.col("size_mb").alias("e")), "db", "left"
    )
    return sized.groupBy(*by).agg(F.sum(F.coalesce("l", "e", F.lit(0))).alias("required_mb"))


def available_space(total_kb: Column, used_kb: Column) -> Column:
    """MB that may still be filled below the disk limit."""
    return (F.lit(DISK_LIMIT) * total_kb - used_kb) / 1024


def table_rates(stats: DataFrame, seconds: int | Column, hostname: Column) -> DataFrame:
    """Rows read and changed per second by (namespace, table); null namespace outside sharded schemas."""
    space = namespace_of_schema(F.col("db"), hostname)
    return _rates(stats.withColumn("namespace", space), ["namespace", "table_name"], seconds)


def schema_rates(stats: DataFrame, seconds: int | Column, hostname: Column) -> DataFrame:
    """Rows read and changed per second by (namespace, schema)."""
    space = namespace_of_schema(F.col("db"), hostname)
    return _rates(stats.withColumn("namespace", space), ["namespace", "db"], seconds)


def _rates(stats: DataFrame, keys: Sequence[str], seconds: int | Column) -> DataFrame:
    return stats.groupBy(*keys).agg(
        whole(F.sum("rows_read"), seconds).alias("rows_read"),
        whole(F.sum("rows_changed"), seconds).alias("rows_changed"),
    )


def user_rates(stats: DataFrame, seconds: int, user: str = "user") -> DataFrame:
    """(user, metric, value): every numeric counter per second; fractions of counters are cut off.

    Columns that are no numbers are left out.
    """
    counters = [c for c in stats.columns if c != user]
    long = stats.select(
        F.regexp_replace(user, "[^a-zA-Z0-9_]", "").alias("user"),
        *[F.col(c).cast("string").alias(c) for c in counters],
    ).unpivot(["user"], counters, "metric", "text")
    value = whole(F.col("text").try_cast("decimal(38,9)").cast("bigint"), seconds)
    return long.select("user", "metric", value.alias("value")).where("value IS NOT NULL")


def global_status_metrics(variables: DataFrame) -> DataFrame:
    """(metric, value) of the variables that are numbers, names in lower case; values are exact."""
    number = F.col("value").try_cast("decimal(38,9)")
    return variables.select(F.lower("name").alias("metric"), number.alias("value")).where("value IS NOT NULL")


def table_row_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact rows per table."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def row_estimate(rows: DataFrame, keys: Sequence[str], by: Sequence[str], one_in: int) -> DataFrame:
    """Estimated rows per table from one in ``one_in`` rows, chosen by a hash of the columns ``by``.

    The same rows are chosen at every run, however the table is dealt out.
    """
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in by]).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    counted = table_row_counts(rows.where(F.pmod(hashed, F.lit(one_in)) == 0), keys)
    return counted.withColumn("cnt", F.col("cnt") * one_in)


def non_blackhole_tables(tables: DataFrame) -> DataFrame:
    """Tables per schema whose engine keeps data; must be 0 for schemas that were moved away."""
    return tables.groupBy("db").agg(F.count_if(F.col("engine") != "BLACKHOLE").alias("tables"))


def writes_after_quiesce(activity: DataFrame) -> DataFrame:
    """(instance, db) that still changed rows after the counters were reset."""
    changed = activity.groupBy("instance", "db").agg(F.sum("rows_changed").alias("rows_changed"))
    return changed.where("rows_changed <> 0")


def variables_map(variables: DataFrame, key: str = "instance") -> DataFrame:
    """(instance, variables): a map of all settings, from one row per setting.

    A server has some hundreds of settings; of a setting given twice the greater value stays.
    """
    single = variables.groupBy(key, "name").agg(F.max("value").alias("value"))
    entries = F.sort_array(F.collect_list(F.struct("name", "value")))
    return single.groupBy(key).agg(F.map_from_entries(entries).alias("variables"))
