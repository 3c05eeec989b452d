"""Table exports: dump files by namespace, table, day and partition, with schema and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dump_line

LAYOUT = ["namespace", "db", "table", "dt", "part"]


def export_namespace(kind: Column, replica_set: Column, host_prefix: Column, db: Column, service_pattern: str) -> Column:
    """Namespace of an export by kind of data.

    ``unsharded``: the replica set; ``flex``: the host prefix; ``sharded``: the host prefix,
    followed by the service when the schema name matches ``service_pattern``.
    """
    service = F.regexp_extract(db, service_pattern, 1)
    sharded = F.when(service != "", F.concat_ws("_", host_prefix, service)).otherwise(host_prefix)
    return (
        F.when(kind == "flex", host_prefix)
        .when(kind == "sharded", sharded)
        .otherwise(replica_set)
    )


def export_day(run_at: Column) -> Column:
    """An export is filed under the day before it runs."""
    return F.date_format(F.date_sub(F.to_date(run_at), 1), "yyyy-MM-dd")


def export_table(
    df: DataFrame,
    root: str,
    namespace: Column | str,
    db: str,
    table: Column | str,
    run_at: Column,
    part: Column | None = None,
    compression: str = "none",
    files_records: int = 0,
) -> None:
    """Write rows as an escaped dump under ``namespace=/db=/table=/dt=/part=``.

    Tasks write their own files; nothing is shuffled. Uncompressed files can be read back in
    byte ranges, compressed ones file by file.
    """
    keyed = df.select(
        dump_line(df).alias("value"),
        (namespace if isinstance(namespace, Column) else F.lit(namespace)).alias("namespace"),
        F.lit(db).alias("db"),
        (table if isinstance(table, Column) else F.lit(table)).alias("table"),
        export_day(run_at).alias("dt"),
        (part if part is not None else F.lit(0)).alias("part"),
    )
    writer = keyed.write.partitionBy(*LAYOUT).option("compression", compression)
    if files_records:
        writer = writer.option("maxRecordsPerFile", files_records)
    # A run replaces what an earlier run of the same day wrote, and nothing else.
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").text(root)


def table_definition(db: str, table: str, df: DataFrame) -> str:
    """CREATE TABLE text of a DataFrame."""
    columns = ",\n".join(f"  `{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"CREATE TABLE `{db}`.`{table}` (\n{columns}\n)"


def export_schema(df: DataFrame, path: str, db: str, table: str) -> None:
    """Write the table's definition beside its data: DDL, then the schema as JSON."""
    spark = df.sparkSession
    text = table_definition(db, table, df) + "\n" + df.schema.json()
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def export_definitions(tables: DataFrame, name: str, layout: DataFrame, path: str, db: str) -> None:
    """Write a definition per table in ``tables``, whose rows are laid out like ``layout``, one folder each."""
    head, _, tail = table_definition(db, "\0", layout).partition("\0")
    text = F.concat(F.lit(head), F.col(name), F.lit(tail + "\n" + layout.schema.json()))
    tables.select(F.col(name).alias("table"), text.alias("value")).write.partitionBy("table").mode("overwrite").text(path)


def positions(status: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per key: heartbeat, log positions and executed ids.

    ``status`` has heartbeat, log, pos and gtids; the newest row of each key is described.
    """
    newest = status.groupBy(*keys).agg(
        F.max("heartbeat").alias("heartbeat"),
        F.max_by(F.struct("log", "pos", "gtids"), F.struct("heartbeat", "log", "pos")).alias("at"),
    )
    document = F.struct(
        F.date_format("heartbeat", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("heartbeat"),
        F.array(F.struct(F.col("at.log").alias("file"), F.col("at.pos").alias("pos"))).alias("repl_positions"),
        F.col("at.gtids").alias("Executed_Gtid_Set"),
    )
    return newest.select(*keys, F.to_json(document).alias("value"))


def export_position(status: DataFrame, path: str, keys: list[str]) -> None:
    """Write the position documents, one folder per key."""
    positions(status, keys).write.partitionBy(*keys).mode("overwrite").text(path)
