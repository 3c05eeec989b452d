"""Expected against actual.

Set comparisons put both sides on top of each other and group by the full key, so they are
combined before the shuffle, take duplicates in their stride and never pair rows up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key with ``in_left`` and ``in_right``."""
    both = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return both.groupBy(*keys).agg(
        (F.max("l") == 1).alias("in_left"), (F.max("r") == 1).alias("in_right")
    )


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return presence(left, right, keys).where("in_left AND NOT in_right").select(*keys)


def symmetric_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with ``only_in``."""
    found = presence(left, right, keys).where("in_left <> in_right")
    return found.select(*keys, F.when(F.col("in_left"), "left").otherwise("right").alias("only_in"))


def name_collisions(tables: DataFrame, old: str, new: str, schema: str = "db", table: str = "table_name") -> DataFrame:
    """Table names present in both of two schemas."""
    per_name = tables.where(F.col(schema).isin(old, new)).groupBy(table).agg(
        F.count_if(F.col(schema) == old).alias("o"), F.count_if(F.col(schema) == new).alias("n")
    )
    return per_name.where("o > 0 AND n > 0").select(table)


def shard_mismatches(expected: DataFrame, actual: DataFrame, activity: DataFrame) -> DataFrame:
    """(replica_set, db, finding): ``orphaned``, ``orphaned_but_used`` or ``missing``.

    Replica sets without any expected database are not sharded and are skipped. ``activity``
    has rows_changed per (replica_set, db).
    """
    keys = ["replica_set", "db"]
    sharded = expected.select("replica_set").distinct()
    wrong = presence(expected, actual, keys).where("in_left <> in_right")
    wrong = wrong.join(sharded, "replica_set", "left_semi")
    used = activity.groupBy(*keys).agg(F.sum("rows_changed").alias("changed"))
    judged = wrong.join(used, keys, "left")
    finding = (
        F.when(F.col("in_left"), "missing")
        .when(F.coalesce("changed", F.lit(0)) != 0, "orphaned_but_used")
        .otherwise("orphaned")
    )
    return judged.select(*keys, finding.alias("finding"))


def missing_dbs(mapping: DataFrame, actual: DataFrame) -> DataFrame:
    """(replica_set, db) pairs that are mapped but absent."""
    return difference(mapping, actual, ["replica_set", "db"])


def unused_hosts(owned: DataFrame, discovered: DataFrame, protected: DataFrame, host: str = "hostname") -> DataFrame:
    """Owned hosts neither discovered nor protected."""
    known = discovered.select(host).unionByName(protected.select(host))
    return owned.join(known.distinct(), host, "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, problem, differences): ``missing``, ``unexpected`` or ``mismatch`` with the columns' values.

    Keys are unique on each side.
    """
    ours = expected.select(*keys, F.struct(*columns).alias("e"))
    theirs = actual.select(*keys, F.struct(*columns).alias("a"))
    both = ours.join(theirs, list(keys), "full_outer")

    def shown(side: str, c: str) -> Column:
        return F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("NULL"))

    changes = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")),
                    F.concat(F.lit(f"{c}: "), shown("e", c), F.lit(" -> "), shown("a", c)),
                )
                for c in columns
            ]
        )
    )
    problem = (
        F.when(F.col("a").isNull(), "missing")
        .when(F.col("e").isNull(), "unexpected")
        .when(F.size(changes) > 0, "mismatch")
    )
    text = F.when(problem == "mismatch", F.array_join(changes, "; ")).otherwise("")
    found = both.select(*keys, problem.alias("problem"), text.alias("differences"))
    return found.where("problem IS NOT NULL")


def exists_in(df: DataFrame, ref: DataFrame, keys: Sequence[str], flag: str | None = None) -> DataFrame:
    """Rows whose key is in ``ref``; with ``flag``, all rows and whether it is."""
    known = ref.select(*keys).distinct()
    if flag is None:
        return df.join(known, list(keys), "left_semi")
    marked = df.join(known.withColumn(flag, F.lit(True)), list(keys), "left")
    return marked.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def already_done(work: DataFrame, log: DataFrame, keys: Sequence[str], done: bool = True) -> DataFrame:
    """Work items that are in the log (or, with ``done=False``, are not yet)."""
    return work.join(log.select(*keys).distinct(), list(keys), "left_semi" if done else "left_anti")


def pending_transition(log: DataFrame, previous: str, following: str, in_window: Column) -> DataFrame:
    """Rows that entered ``previous`` inside the window and whose instance never entered ``following``."""
    entered = log.where((F.col("activity") == previous) & in_window)
    left = log.where(F.col("activity") == following).select("instance_id").distinct()
    return entered.join(left, "instance_id", "left_anti")


def blocked_by_remote_lock(parts: DataFrame, locks: DataFrame, hostname: str) -> DataFrame:
    """Parts with an active lock held by another host on the same port."""
    held = locks.where(F.col("lock_active").isNotNull() & (F.col("hostname") != hostname))
    keys = ["table_name", "partition_number", "port"]
    return parts.join(held.select(*keys).distinct(), keys, "left_semi")


# Completeness of exports -----------------------------------------------------------------


def export_status(shards: DataFrame, tables: DataFrame, objects: DataFrame) -> DataFrame:
    """(shard_type, table_name, expected, found, complete) without listing what is expected.

    Every shard of a type must hold every (table, partition) of that type, so the expected
    number is a product of two counts. ``objects`` has (shard, table_name, part, size); empty
    objects count as absent.
    """
    n_shards = shards.groupBy("shard_type").agg(F.count_distinct("shard").alias("n_shards"))
    n_parts = tables.groupBy("shard_type", "table_name").agg(F.count_distinct("part").alias("n_parts"))
    stored = objects.where("size > 0").select("shard", "table_name", "part").distinct()
    placed = stored.join(shards.select("shard", "shard_type").distinct(), "shard")
    wanted = tables.select("shard_type", "table_name", "part").distinct()
    found = (
        placed.join(wanted, ["shard_type", "table_name", "part"], "left_semi")
        .groupBy("shard_type", "table_name")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    counts = n_parts.join(n_shards, "shard_type").join(found, ["shard_type", "table_name"], "left")
    expected = (F.col("n_shards") * F.col("n_parts")).cast("long")
    return counts.select(
        "shard_type",
        "table_name",
        expected.alias("expected"),
        F.coalesce("found", F.lit(0)).cast("long").alias("found"),
    ).withColumn("complete", F.col("expected") == F.col("found"))


def expected_objects(shards: DataFrame, tables: DataFrame) -> DataFrame:
    """(shard, table_name, part) that must exist: every part of a type for each of its shards.

    An equi-join on the type; its size is the size of the answer, the parts of a type being
    bounded by its schema.
    """
    members = shards.select("shard_type", "shard").distinct()
    parts = tables.select("shard_type", "table_name", "part").distinct()
    return members.join(parts, "shard_type")


def missing_objects(shards: DataFrame, tables: DataFrame, objects: DataFrame) -> DataFrame:
    """Expected objects that are absent or empty; only incomplete tables are spelt out."""
    status = export_status(shards, tables, objects)
    incomplete = status.where("NOT complete").select("shard_type", "table_name")
    suspect = tables.join(incomplete, ["shard_type", "table_name"], "left_semi")
    stored = objects.where("size > 0").select("shard", "table_name", "part").distinct()
    return expected_objects(shards, suspect).join(stored, ["shard", "table_name", "part"], "left_anti")


def success_markers(status: DataFrame, markers: DataFrame) -> DataFrame:
    """(shard_type, table_name, action): ``create`` for complete tables without a marker, ``remove``
    for markers of incomplete ones, ``keep`` and ``none`` otherwise."""
    keys = ["shard_type", "table_name"]
    known = markers.select(*keys).distinct().withColumn("marked", F.lit(True))
    marked = F.coalesce(F.col("marked"), F.lit(False))
    action = (
        F.when(F.col("complete") & ~marked, "create")
        .when(~F.col("complete") & marked, "remove")
        .when(F.col("complete"), "keep")
        .otherwise("none")
    )
    return status.join(known, keys, "left").select(*keys, action.alias("action"))


def missing_schemas(tables: DataFrame, listing: DataFrame) -> DataFrame:
    """Tables whose schema file is absent; both sides have (db, table_name)."""
    return difference(tables, listing, ["db", "table_name"])
