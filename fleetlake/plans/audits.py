"""Fleet-wide audits put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import backup_file_parts, standardized_replica_set
from ..functions.moments import export_gate
from ..functions.text import normalize_ddl
from ..operators import filters as P
from ..operators import lag as G
from ..operators import lifecycle as Y
from ..operators import lookups as L
from ..operators import reconcile as R
from ..operators import rollups as A
from ..operators.latest import newest_valid_backup
from ..operators.lines import with_line_edits
from ..session import materialize
from ..sources.listing import MIN_BACKUP_BYTES, valid_backups


def export_audit(shards: DataFrame, tables: DataFrame, objects: DataFrame, backup_date: Column, as_of: Column, running: Column) -> DataFrame:
    """(shard_type, tables, complete_tables, missing, verdict) per shard type.

    The verdict is the time gate's while it is too early or the export still runs, else
    ``complete`` or ``incomplete``.
    """
    per_type = R.export_status(shards, tables, objects).groupBy("shard_type").agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if("complete").alias("complete_tables"),
        F.sum(F.col("expected") - F.col("found")).alias("missing"),
    )
    gate = export_gate(backup_date, as_of, running)
    outcome = F.when(F.col("missing") == 0, "complete").otherwise("incomplete")
    return per_type.withColumn("verdict", F.when(gate == "check", outcome).otherwise(gate))


def backup_coverage(listing: DataFrame, replica_sets: DataFrame, as_of: Column, days: int = 5, min_bytes: int = MIN_BACKUP_BYTES) -> DataFrame:
    """(replica_set, path, created, covered): the backup each replica set would be restored from."""
    named = valid_backups(listing, min_bytes).withColumn("f", backup_file_parts(F.col("path")))
    usable = named.where("f.created IS NOT NULL").select(
        standardized_replica_set(F.col("f.host")).alias("replica_set"), "path", F.col("f.created").alias("created"), "modified"
    )
    best = newest_valid_backup(usable, "replica_set", "created", "modified", as_of, days)
    joined = replica_sets.select("replica_set").distinct().join(best, "replica_set", "left")
    return joined.select("replica_set", "path", "created", F.col("path").isNotNull().alias("covered"))


def placement_audit(shard_map: DataFrame, actual: DataFrame, stats: DataFrame) -> DataFrame:
    """(replica_set, db, finding) of shards that are where they should not be, or not where they should."""
    expected = shard_map.select("replica_set", F.col("mysqldb").alias("db")).distinct()
    changed = stats.groupBy("replica_set", "db").agg(F.sum("rows_changed").alias("rows_changed"))
    return R.shard_mismatches(expected, actual, changed)


def line_diff(definitions: DataFrame, seed: Column) -> DataFrame:
    """(hash, sign, line): lines each drifted definition has more (+) or fewer (-) of than the seed.

    One definition stands for each hash. Lines are compared as multisets.
    """
    hashed = definitions.withColumn("__ddl", normalize_ddl(F.col("ddl")))
    one = hashed.groupBy(F.md5(F.col("__ddl").cast("binary")).alias("hash")).agg(F.min("__ddl").alias("ddl"))
    one = one.where(F.col("ddl") != normalize_ddl(seed))
    has = one.select("hash", F.explode(F.split("ddl", "\n")).alias("line"), F.lit(1).alias("n"))
    wants = one.select("hash", F.explode(F.split(normalize_ddl(seed), "\n")).alias("line"), F.lit(-1).alias("n"))
    counts = has.unionByName(wants).groupBy("hash", "line").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")
    return counts.select("hash", F.when(F.col("n") > 0, "+").otherwise("-").alias("sign"), "line", F.abs("n").alias("n"))


def ordered_line_diff(definitions: DataFrame, seed: Column) -> DataFrame:
    """(hash, place, sign, line): each drifted definition as an ordered difference from the seed.

    One definition stands for each hash, and is compared once however many places hold it. Lines are kept (blank), missing (-)
    or added (+); lines that only changed places are missing at one and added at the other.
    """
    hashed = definitions.withColumn("__ddl", normalize_ddl(F.col("ddl")))
    one = hashed.groupBy(F.md5(F.col("__ddl").cast("binary")).alias("hash")).agg(F.min("__ddl").alias("ddl"))
    drifted = one.where(F.col("ddl") != normalize_ddl(seed))
    edits = with_line_edits(drifted, normalize_ddl(seed), F.col("ddl"))
    return edits.select("hash", F.posexplode("edits").alias("place", "x")).select("hash", "place", "x.*")


def drift_audit(definitions: DataFrame, seed: Column) -> tuple[DataFrame, DataFrame]:
    """(where each drifted definition is found, how it differs line by line, in order)."""
    return A.schema_drift(definitions, seed), ordered_line_diff(definitions, seed)


def server_report(
    inventory: DataFrame, discovered: DataFrame, protected: DataFrame, retirement_log: DataFrame, as_of: Column,
    activities: Sequence[str] = (Y.RESET_STATS, Y.SHUTDOWN_MYSQL, Y.TERMINATE_INSTANCE), min_rows: int = P.MIN_INVENTORY,
) -> DataFrame:
    """(hostname, state): unused servers, and servers in the retirement queue with their state.

    Refuses to judge by an inventory that is suspiciously short.
    """
    trusted = P.min_rows_gate(inventory, min_rows)
    unused = R.unused_hosts(P.owned_hosts(trusted, discovered, as_of), discovered, protected).select("hostname")
    queue = Y.lifecycle_state(retirement_log, as_of, activities).select("hostname", "state")
    both = unused.select("hostname", F.lit("UNUSED").alias("state"), F.lit(0).alias("rank")).unionByName(
        queue.withColumn("rank", F.lit(1))
    )
    return both.groupBy("hostname").agg(F.max_by("state", F.struct("rank", "state")).alias("state"))


def replication_health(status: DataFrame, logs: DataFrame, heartbeats: DataFrame, config: DataFrame, as_of: Column, slice_width: int = G.LOG_SLICE) -> DataFrame:
    """(instance, sql_bytes, io_bytes, sbm, problems) of every replica.

    ``status`` has instance, host, port, master, master_host, master_port, the io and sql
    positions and thread states; ``heartbeats`` has master and ts.
    """
    positions = {"io": ("io_log", "io_pos"), "sql": ("sql_log", "sql_pos")}
    bytes_ = G.bytes_behind(status, logs, positions, slice_width=slice_width)
    beats = G.seconds_behind(heartbeats, "master", "ts", as_of).select("master", "sbm")
    sick = L.topology_check(status, config).withColumnRenamed("problems", "topology")
    joined = status.select("instance", "host", "port", "master").join(bytes_, "instance").join(beats, "master", "left")
    joined = joined.join(sick.distinct(), ["host", "port"], "left")
    lag = G.lag_problems("normal", F.col("sql_bytes"), F.col("io_bytes"), F.col("sbm"))
    problems = F.concat_ws(", ", F.nullif(lag, F.lit("")), "topology")
    return joined.select("instance", "sql_bytes", "io_bytes", "sbm", problems.alias("problems"))


def migration_readiness(
    source_ddl: DataFrame, target_ddl: DataFrame, source_counts: DataFrame, target_counts: DataFrame,
    required: DataFrame, available: DataFrame, locks: DataFrame, exact: bool = True,
) -> DataFrame:
    """(problem, db, detail) of everything that stands in the way; no row means ready.

    Definitions are compared where a table is on both sides; ``required`` and ``available`` have
    db-independent totals per replica_set; ``locks`` are active migrations (see ``lifecycle``).
    """
    keys = ["db", "table_name"]
    absent = R.symmetric_difference(source_ddl, target_ddl, keys).select(
        F.lit("table_only_on_one_side").alias("problem"), "db", F.concat_ws(" ", "table_name", "only_in").alias("detail")
    )
    ours = source_ddl.select(*keys, normalize_ddl(F.col("ddl")).alias("ddl"))
    theirs = target_ddl.select(*keys, normalize_ddl(F.col("ddl")).alias("__other"))
    changed = ours.join(theirs, keys).where("ddl <> __other").select(
        F.lit("schema_differs").alias("problem"), "db", F.col("table_name").cast("string").alias("detail")
    )
    counts = A.row_count_check(source_counts, target_counts, exact).select(
        F.lit("row_count").alias("problem"), "db", F.concat_ws(" ", "table_name", "problem").alias("detail")
    )
    space = required.join(available, "replica_set").where("available_mb < required_mb").select(
        F.lit("disk_space").alias("problem"), F.lit("").alias("db"), F.col("replica_set").cast("string").alias("detail")
    )
    held = locks.select(
        F.lit("migration_lock").alias("problem"), F.lit("").alias("db"), F.concat_ws(" ", "replica_set", "side").alias("detail")
    )
    return absent.unionByName(changed).unionByName(counts).unionByName(space).unionByName(held).distinct()


def grant_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Accounts that are missing, unexpected or different: both sides have user, host and grant columns."""
    return R.reconcile(expected, actual, ["user", "host"], ["privileges", "hashed_password", "grant_option"])


def mapping_changes(shard_map: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with ``outcome``: applied, warning or error. At most one change per shard.

    ``changes`` has op (move, add, add_service, add_namespace), service, namespace, shard,
    old_replica_set, new_replica_set and mysqldb.
    """
    keys = ["service", "namespace", "shard"]
    now = shard_map.select(*keys, F.col("mysqldb").alias("__db"), F.col("replica_set").alias("__rs"))
    services = shard_map.select("service").distinct().withColumn("__service", F.lit(True))
    spaces = shard_map.select("service", "namespace").distinct().withColumn("__space", F.lit(True))
    joined = changes.join(now, keys, "left").join(services, "service", "left").join(spaces, ["service", "namespace"], "left")
    here, there = F.col("__rs"), F.col("new_replica_set")
    moved = (
        F.when(here.isNull(), "error").when(here == F.col("old_replica_set"), "applied").when(here == there, "warning").otherwise("error")
    )
    same = (F.col("__db") == F.col("mysqldb")) & (here == there)
    added = (
        F.when(F.col("__space").isNull(), "error").when(here.isNull(), "applied").when(same, "warning").otherwise("error")
    )
    new_space = F.when(F.col("__service").isNull() | F.col("__space").isNotNull(), "error").otherwise("applied")
    outcome = (
        F.when(F.col("op") == "move", moved)
        .when(F.col("op") == "add", added)
        .when(F.col("op") == "add_service", F.when(F.col("__service").isNull(), "applied").otherwise("error"))
        .when(F.col("op") == "add_namespace", new_space)
        .otherwise("error")
    )
    return joined.select(*changes.columns, outcome.alias("outcome"))


def changed_mapping(shard_map: DataFrame, judged: DataFrame) -> DataFrame:
    """The shard map after the applied changes."""
    applied = judged.where("outcome = 'applied' AND op IN ('move', 'add')").select(
        "service", "namespace", "shard", F.col("mysqldb").alias("__db"), F.col("new_replica_set").alias("__rs")
    )
    merged = shard_map.join(applied, ["service", "namespace", "shard"], "full_outer")
    return merged.select(
        "service", "namespace", "shard", F.coalesce("mysqldb", "__db").alias("mysqldb"), F.coalesce("__rs", "replica_set").alias("replica_set")
    )


def validated_mapping(shard_map: DataFrame, changes: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judged changes, new map, databases the new map names but masters lack)."""
    judged = materialize(mapping_changes(shard_map, changes), "judged")
    after = changed_mapping(shard_map, judged)
    pairs = after.select("replica_set", F.col("mysqldb").alias("db"))
    return judged, after, R.missing_dbs(pairs, actual)
