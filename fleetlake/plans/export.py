"""Table export: choose, write, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import select_for_export
from ..session import materialize
from ..sinks.checked import write_export
from ..sinks.export import export_day, export_definitions, export_table, positions


def _choose(rows: DataFrame, host: str, db: str, table_column: str, rules: dict[str, dict]):
    """(chosen, names of the chosen tables, their rows) by the rules."""
    names = rows.select(F.col(table_column).alias("t")).distinct()
    parts = names.select(
        F.lit(host.split("-")[0]).alias("prefix"),
        F.concat_ws(".", F.lit(db), "t").alias("full_name"),
        F.lit(None).cast("string").alias("partition"),
        F.lit(0).alias("position"),
    )
    chosen = materialize(select_for_export(parts, rules), "chosen")
    # Names may hold dots, so a name is not taken back from the full one.
    full = names.select(F.col("t").alias(table_column), F.concat_ws(".", F.lit(db), "t").alias("full_name"))
    wanted = full.join(chosen, "full_name", "left_semi").select(table_column)
    return chosen, wanted, rows.join(wanted, table_column, "left_semi").select(*rows.columns)


def export_run(
    rows: DataFrame, root: str, host: str, db: str, table_column: str, rules: dict[str, dict], run_at: Column,
    part: Column | None = None,
) -> DataFrame:
    """Export all tables of a schema that the rules let through; returns what was chosen.

    ``rows`` holds the rows of all tables, ``table_column`` says of which. The export filters
    and writes in one pass: the choice is a short list of tables that joins the rows, and each
    table becomes a folder of the layout. Running it again replaces the day's folders. Each chosen
    table's definition goes to ``_schema`` beside the data.
    """
    chosen, wanted, kept = _choose(rows, host, db, table_column, rules)
    export_definitions(wanted, table_column, rows.drop(table_column), f"{root}/_schema", db)
    # The table's name is a column of the rows, so one write files every table in its own folder.
    export_table(kept, root, host.rsplit("-", 1)[0], db, F.col(table_column), run_at, part)
    return chosen


def checked_export(
    rows: DataFrame, root: str, name: str, host: str, db: str, table_column: str, rules: dict[str, dict],
    run_at: Column, status: DataFrame, part: Column | None = None, compression: str = "none",
) -> DataFrame:
    """``export_run`` as one commit under ``name``: data, schema, position and marker stand together or not at all.

    ``status`` has heartbeat, log, pos and gtids of the exported server; its newest row is taken before the
    rows are read, so replaying from the position misses nothing. Without a row there is no export.
    """
    newest = positions(status.select(F.lit(host).alias("instance"), "heartbeat", "log", "pos", "gtids"), ["instance"]).head(1)
    if not newest:
        raise ValueError(f"{host} has no position, so nothing was exported")
    chosen, _, kept = _choose(rows, host, db, table_column, rules)
    places = {
        "namespace": F.lit(host.rsplit("-", 1)[0]), "db": F.lit(db), "table": F.col(table_column),
        "dt": export_day(run_at), "part": part if part is not None else F.lit(0),
    }
    write_export(kept, root, name, places, newest[0]["value"], compression)
    return chosen
