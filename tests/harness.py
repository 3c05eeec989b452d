"""Runs a registered query in Spark and its SQL twin in DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value.normalize()))
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, dt.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return (type(value).__name__, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    got_columns, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_columns, want = _rows(names, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns differ: spark {got_columns} sql {want_columns}"
    if got != want:
        only_spark, only_sql = got - want, want - got
        return (
            f"rows: spark {sum(got.values())} sql {sum(want.values())}; "
            f"only spark {sum(only_spark.values())}: {list(only_spark)[:2]}; "
            f"only sql {sum(only_sql.values())}: {list(only_sql)[:2]}"
        )
    return None
