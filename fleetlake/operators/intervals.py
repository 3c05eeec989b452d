"""Transaction id sets as interval rows (uuid, lo, hi), both ends included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import neighbour, number_slice, running_total

SLICE_WIDTH = 1_000_000
EXPAND_STEP = 10_000


def parse_gtid_sets(df: DataFrame, text: str = "gtids", keep: Sequence[str] = ()) -> DataFrame:
    """Interval rows of ``uuid:1-5:7,uuid2:3`` texts."""
    members = df.select(*keep, F.explode(F.split(F.col(text), ",")).alias("m"))
    named = members.select(
        *keep,
        F.trim(F.replace(F.substring_index("m", ":", 1), F.lit("\n"), F.lit(""))).alias("uuid"),
        F.explode(F.slice(F.split("m", ":"), 2, F.size(F.split("m", ":")))).alias("r"),
    )
    ends = F.split(F.trim("r"), "-")
    return named.select(
        *keep,
        "uuid",
        ends[0].cast("long").alias("lo"),
        F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0]).cast("long").alias("hi"),
    )


def gtid_text(intervals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One text per interval, as the server writes it: ``uuid:lo-hi`` or ``uuid:n``."""
    span = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(
        F.concat_ws("-", "lo", "hi")
    )
    return intervals.select(*keys, F.concat_ws(":", "uuid", span).alias("gtid"))


def _borders(intervals: DataFrame, keys: Sequence[str], source: int, reference: int) -> DataFrame:
    ends = F.array(
        F.struct(F.col("lo").alias("pos"), F.lit(1).alias("step")),
        F.struct((F.col("hi") + 1).alias("pos"), F.lit(-1).alias("step")),
    )
    rows = intervals.select(*keys, F.explode(ends).alias("e"))
    return rows.select(
        *keys,
        "e.pos",
        (F.col("e.step") * source).cast("long").alias("s"),
        (F.col("e.step") * reference).cast("long").alias("r"),
    )


def _sweep(borders: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Maximal intervals covered by the source and not by the reference.

    Borders at one position are added up first, then counted along each key slice by slice.
    A position is a turn when the state after it differs from the state before it, which the
    counts tell without looking at other rows. Turns are few next to borders and are written
    once, as pairing them reads them twice.
    """
    at = borders.groupBy(*keys, "pos").agg(F.sum("s").alias("s"), F.sum("r").alias("r"))
    at = at.where("s <> 0 OR r <> 0")

    def cut():
        return number_slice("pos", width)

    counted = running_total(at, keys, "pos", cut(), {"in_s": F.col("s"), "in_r": F.col("r")})
    inside = (F.col("in_s") > 0) & (F.col("in_r") == 0)
    was_inside = (F.col("in_s") - F.col("s") > 0) & (F.col("in_r") - F.col("r") == 0)
    turns = counted.where(inside != was_inside).select(*keys, "pos", inside.alias("inside"))
    turns = materialize(turns, "turns")
    paired = neighbour(turns, keys, ["pos"], cut(), {"end": "pos"}, following=True)
    return paired.where("inside").select(*keys, F.col("pos").alias("lo"), (F.col("end") - 1).alias("hi"))


def gtid_subtract(
    source: DataFrame, reference: DataFrame, keys: Sequence[str] = ("uuid",), width: int = SLICE_WIDTH
) -> DataFrame:
    """Ids of the source that the reference lacks, as maximal intervals."""
    keys = list(keys)
    return _sweep(_borders(source, keys, 1, 0).unionByName(_borders(reference, keys, 0, 1)), keys, width)


def merge_intervals(intervals: DataFrame, keys: Sequence[str] = ("uuid",), width: int = SLICE_WIDTH) -> DataFrame:
    """The same ids as maximal intervals: overlapping and adjoining ones are joined."""
    return _sweep(_borders(intervals, list(keys), 1, 0), list(keys), width)


def gtid_expand(intervals: DataFrame, keys: Sequence[str] = ("uuid",), step: int = EXPAND_STEP) -> DataFrame:
    """One row per transaction. Long intervals are cut first, so no row holds more than ``step`` ids."""
    starts = intervals.select(*keys, "hi", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("lo"))
    piece = F.sequence("lo", F.least(F.col("hi"), F.col("lo") + F.lit(step - 1)))
    return starts.select(*keys, F.explode(piece).alias("n"))
