"""Ordered operators: any slice width and any partitioning give the plain window's answer."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlake.operators import intervals as I
from fleetlake.operators import ordered as O


@pytest.fixture(scope="module")
def line(spark):
    rng = random.Random(4)
    # One key holds half of the rows; null is a key like any other.
    rows = [(rng.choice([0, 0, None]) if rng.random() < 0.7 else rng.randint(1, 5), i, rng.randint(0, 400), None if rng.random() < 0.4 else rng.randint(0, 99)) for i in range(600)]
    return spark.createDataFrame(rows, "key int, id int, at int, v int").cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_against_plain_windows(line, width):
    plain = Window.partitionBy("key").orderBy("at", "id")
    whole = plain.rowsBetween(Window.unboundedPreceding, 0)
    cut = O.number_slice("at", width)
    total = O.running_total(line, ["key"], "at", cut, {"s": F.coalesce("v", F.lit(0))}, tie=["id"])
    assert rows_of(total.select("id", "s")) == rows_of(line.select("id", F.sum(F.coalesce("v", F.lit(0))).over(whole)))
    assert rows_of(O.ordinal(line, ["key"], ["at", "id"], cut, "n").select("id", "n")) == rows_of(
        line.select("id", F.row_number().over(plain) - 1)
    )
    for following, fn in ((False, F.lag), (True, F.lead)):
        near = O.neighbour(line, ["key"], ["at", "id"], cut, {"p": "v", "q": "id"}, following=following)
        assert rows_of(near.select("id", "p", "q")) == rows_of(line.select("id", fn("v").over(plain), fn("id").over(plain)))
    last = O.carry_last(line, ["key"], ["at", "id"], cut, {"c": F.col("v")})
    assert rows_of(last.select("id", "c")) == rows_of(line.select("id", F.last("v", ignorenulls=True).over(whole)))


@pytest.mark.parametrize("width", [1, 13, 1000])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join(line, width, direction):
    left = line.where("id % 3 = 0").select("key", "id", "at")
    right = line.where("id % 3 <> 0").select("key", F.col("at").alias("seen"), F.col("id").alias("rid"))
    got = O.asof_join(left, right, ["key"], "at", "seen", lambda c: O.number_slice(c, width), ["seen", "rid"], direction=direction, tie="rid")
    lefts, rights = left.collect(), right.collect()
    wanted = []
    for l in lefts:
        if direction == "backward":
            near = [(-r.seen, r.rid) for r in rights if r.key == l.key and r.seen <= l.at]
        else:
            near = [(r.seen, r.rid) for r in rights if r.key == l.key and r.seen >= l.at]
        best = min(near, default=None)
        wanted.append((l.id, abs(best[0]) if best else None, best[1] if best else None))
    assert sorted((r.id, r.seen, r.rid) for r in got.collect()) == sorted(wanted)


def test_same_answer_at_any_partitioning(spark, line):
    answers = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        total = O.running_total(line.repartition(int(n)), ["key"], "at", O.number_slice("at", 20), {"s": F.lit(1)}, tie=["id"])
        answers.append(rows_of(total.select("id", "s")))
    assert answers[0] == answers[1]


def expand(rows):
    return {(r.uuid, n) for r in rows for n in range(r.lo, r.hi + 1)}


def test_gtid_subtract_known(spark):
    texts = spark.createDataFrame([("u:1-10:15-20,\nw:1-2", "u:3-5:18-30")], "s string, r string")
    got = I.gtid_subtract(I.parse_gtid_sets(texts, "s"), I.parse_gtid_sets(texts, "r"))
    assert sorted(r.gtid for r in I.gtid_text(got).collect()) == ["u:1-2", "u:15-17", "u:6-10", "w:1-2"]


@pytest.mark.parametrize("width", [3, 10_000])
def test_gtid_subtract_random(spark, width):
    rng = random.Random(9)

    def some():
        return [(rng.choice("ab"), lo, lo + rng.randint(0, 6)) for lo in (rng.randint(1, 60) for _ in range(12))]

    schema = "uuid string, lo long, hi long"
    a, b = spark.createDataFrame(some(), schema), spark.createDataFrame(some(), schema)
    got = I.gtid_subtract(a, b, width=width).collect()
    assert expand(got) == expand(a.collect()) - expand(b.collect())
    # Maximal: no two of the result adjoin.
    assert not any(x.uuid == y.uuid and x.hi + 1 == y.lo for x in got for y in got)
    expanded = I.gtid_expand(I.merge_intervals(a, width=width), step=2).collect()
    assert sorted((r.uuid, r.n) for r in expanded) == sorted(expand(a.collect()))
