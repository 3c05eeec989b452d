"""Ordered operators that do not put a whole key into one task.

A plain window sorts every row of a key in one task, which a hot key makes impossible. Here
each key is cut into slices, a pure function of the ordering column, and the work is done in
two levels:

1. a window inside (key, slice) does the row-level work;
2. one row per (key, slice), aggregated map-side first, goes through a window over slices,
   and what it carries is joined back on (key, slice).

Slices depend on the row alone, so a task that is run again puts each row in the same slice.
Choose the width so that a slice of the busiest key fits a task; the number of slices per key
is the key's range divided by the width. Null is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"


def time_slice(ts: str | Column, seconds: int) -> Column:
    """Slice number of a timestamp without zone: whole steps of ``seconds`` from 1970 on."""
    col = F.col(ts) if isinstance(ts, str) else ts
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)
    return F.call_function("div", epoch, F.lit(seconds)).cast("long")


def number_slice(value: str | Column, width: int) -> Column:
    """Slice number of an integer: whole steps of ``width``."""
    col = F.col(value) if isinstance(value, str) else value
    return F.call_function("div", col, F.lit(width)).cast("long")


def _cut(df: DataFrame, keys: Sequence[str], slice_col: Column) -> DataFrame:
    """Add the keys and the slice as one struct; as a struct, null keys are equal to each other."""
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    return df.withColumn(SLICE, F.struct(*parts, slice_col.alias("at")))


def _by_slice(order: Sequence[Column]):
    return Window.partitionBy(SLICE).orderBy(*order)


def _over_slices(keys: Sequence[str], descending: bool = False):
    at = F.col(SLICE)["at"]
    window = Window.orderBy(at.desc() if descending else at.asc())
    return window.partitionBy(*[F.col(SLICE)[f"k{i}"] for i in range(len(keys))]) if keys else window


def _attach(df: DataFrame, summary: DataFrame) -> DataFrame:
    return df.join(summary, SLICE, "left")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    slice_col: Column,
    totals: dict[str, Column],
    *,
    tie: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add running sums, current row included. Rows with equal (order, tie) count one by one."""
    sliced = _cut(df, keys, slice_col)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = _by_slice([direction(c) for c in (order, *tie)]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = _over_slices(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
    summary = sliced.groupBy(SLICE).agg(
        *[F.sum(value).alias(f"__{out}") for out, value in totals.items()]
    )
    summary = summary.select(
        SLICE, *[F.sum(f"__{out}").over(before).alias(f"__{out}") for out in totals]
    )
    local = sliced.withColumns({out: F.sum(value).over(inside) for out, value in totals.items()})
    joined = _attach(local, summary).withColumns(
        {
            out: F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col(f"__{out}"), F.lit(0))
            for out in totals
        }
    )
    return joined.drop(SLICE, *[f"__{out}" for out in totals])


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    out: str = "ordinal",
    start: int = 0,
) -> DataFrame:
    """Number rows of a key in order, from ``start``. ``slice_col`` must not fall as order grows."""
    sliced = _cut(df, keys, slice_col)
    inside = _by_slice([F.col(c) for c in order])
    before = _over_slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    summary = sliced.groupBy(SLICE).agg(F.count(F.lit(1)).alias("__n"))
    summary = summary.select(SLICE, F.sum("__n").over(before).alias("__n"))
    joined = _attach(sliced.withColumn(out, F.row_number().over(inside)), summary)
    number = F.col(out) + F.coalesce(F.col("__n"), F.lit(0)) + F.lit(start - 1)
    return joined.withColumn(out, number.cast("long")).drop(SLICE, "__n")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    columns: dict[str, str],
    *,
    following: bool = False,
) -> DataFrame:
    """Add columns of the row just before (or after) within the key: ``{new name: source column}``."""
    sliced = _cut(df, keys, slice_col)
    inside = _by_slice([F.col(c) for c in order])
    packed = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    position = F.struct(*[F.col(c) for c in order])
    if following:
        local, edge = F.lead(packed).over(inside), F.min_by(packed, position)
        across = F.lead("__edge").over(_over_slices(keys))
    else:
        local, edge = F.lag(packed).over(inside), F.max_by(packed, position)
        across = F.lag("__edge").over(_over_slices(keys))
    summary = sliced.groupBy(SLICE).agg(edge.alias("__edge"))
    summary = summary.select(SLICE, across.alias("__edge"))
    joined = _attach(sliced.withColumn("__near", local), summary)
    found = F.coalesce(F.col("__near"), F.col("__edge"))
    return joined.withColumns({out: found[out] for out in columns}).drop(SLICE, "__near", "__edge")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_col: Column,
    columns: dict[str, Column],
) -> DataFrame:
    """Add, per new column, the last non-null value up to and including the current row."""
    staged = {f"__v_{out}": value for out, value in columns.items()}
    sliced = _cut(df, keys, slice_col).withColumns(staged)
    inside = _by_slice([F.col(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = _over_slices(keys).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*[F.col(c) for c in order])
    summary = sliced.groupBy(SLICE).agg(
        *[
            F.max_by(f"__v_{out}", F.when(F.col(f"__v_{out}").isNotNull(), position)).alias(f"__s_{out}")
            for out in columns
        ]
    )
    summary = summary.select(
        SLICE,
        *[F.last(f"__s_{out}", ignorenulls=True).over(before).alias(f"__s_{out}") for out in columns],
    )
    local = sliced.withColumns(
        {f"__v_{out}": F.last(f"__v_{out}", ignorenulls=True).over(inside) for out in columns}
    )
    joined = _attach(local, summary).withColumns(
        {out: F.coalesce(F.col(f"__v_{out}"), F.col(f"__s_{out}")) for out in columns}
    )
    return joined.drop(SLICE, *[f"__{kind}_{out}" for out in columns for kind in "vs"])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    slice_of,
    columns: Sequence[str],
    *,
    direction: str = "backward",
    tie: str | None = None,
) -> DataFrame:
    """Each left row with the nearest right row at or before it (or at or after: ``forward``).

    Both sides are laid on one line per key and the right row is carried along it, so the
    cost is one shuffle of both sides by (key, slice) and no pair is ever formed. ``slice_of``
    turns a position column into a slice. Left rows without a match keep null columns. Of
    right rows at one position, the smallest ``tie`` (an integer column) is taken.
    """
    forward = direction == "forward"
    carried = F.struct(*[F.col(c) for c in columns])
    rank = F.col(tie).cast("long") if tie else F.xxhash64(*[F.col(c) for c in columns])
    left_side = left.select(
        *keys,
        F.col(left_on).alias("__at"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
        F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType).alias("__right"),
        F.lit(None).cast("long").alias("__tie"),
        F.lit(1).alias("__side"),
    )
    right_side = right.select(
        *keys,
        F.col(right_on).alias("__at"),
        F.lit(None).cast(left_side.schema["__left"].dataType).alias("__left"),
        carried.alias("__right"),
        rank.alias("__tie"),
        F.lit(0).alias("__side"),
    )
    line = _cut(left_side.unionByName(right_side), keys, slice_of(F.col("__at")))
    value = F.col("__right")
    # Rows are read towards the probe, so that the last right row seen is the nearest one; a frame
    # that looks ahead would be computed anew for every row. Of right rows at one position the
    # smallest tie comes last. Right rows of a position come before its probes.
    at = F.col("__at").desc() if forward else F.col("__at").asc()
    order = [at, F.col("__side"), F.col("__tie").desc()]
    seen = _by_slice(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = F.last(value, ignorenulls=True).over(seen)
    if forward:
        edge = F.min_by(value, F.when(value.isNotNull(), F.struct("__at", "__tie")))
    else:
        position = F.struct("__at", F.bitwise_not("__tie").alias("t"))
        edge = F.max_by(value, F.when(value.isNotNull(), position))
    passed = _over_slices(keys, forward).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("__edge", ignorenulls=True).over(passed)
    summary = line.groupBy(SLICE).agg(edge.alias("__edge"))
    summary = summary.select(SLICE, carry.alias("__edge"))
    probes = line.withColumn("__near", local).where(F.col("__left").isNotNull())
    joined = _attach(probes, summary)
    found = F.coalesce(F.col("__near"), F.col("__edge"))
    return joined.select("__left.*", *[found[c].alias(c) for c in columns])
