"""State machines with timers, the keyed table's layout, late rows over many batches, ordered line diffs."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlake.operators.lines import line_edits, with_line_edits
from fleetlake.plans.audits import ordered_line_diff
from fleetlake.session import scratch
from fleetlake.sinks.upsert import KeyedTable
from fleetlake.streaming import state, timers, windows

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run_in_batches(spark, batches, schema, make):
    """Rows that a stream gives out when ``batches`` arrive one after the other."""
    session, root = timers.stateful_session(spark), scratch(spark, "arriving")
    out, checkpoint = scratch(spark, "machine"), scratch(spark, "machine-checkpoint")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        stream = session.readStream.schema(schema).parquet(root)
        state.run_available(make(stream), out, checkpoint)  # each run goes on where the last one stopped
    return spark.read.parquet(out).collect()


LEASES = "part string, holder string, kind string, ts timestamp, event_id long"


def leases(stream):
    return timers.lease_stream(stream, ["part"], "ts", "event_id", seconds=300, watermark="100 seconds")


def outcomes(rows):
    seconds = lambda t: None if t is None else int((t - START).total_seconds())
    return sorted(
        ((r["part"], seconds(r["at"]), r["outcome"], r["holder"], seconds(r["lease_start"]), r["n_events"], r["held_by"]) for r in rows),
        key=str,
    )


def test_leases_are_taken_extended_released_refused_and_expire(spark):
    first = [
        ("p", "a", "take", at(0), 1), ("p", "b", "take", at(10), 2), ("p", "a", "extend", at(250), 3), ("p", "b", "extend", at(260), 4),
        ("p", "a", "release", at(500), 5), ("p", "b", "take", at(510), 6), ("q", "a", "take", at(0), 7), ("p", "a", "release", at(505), 8),
    ]
    repeats = [first[0], first[5], ("p", "b", "take", at(510), 6), ("p", "c", "take", at(809), 9), ("q", "a", "take", at(5000), 10)]
    last = [("p", "d", "take", at(4000), 11), ("q", "z", "take", at(6000), 12)]
    found = outcomes(run_in_batches(spark, [first, repeats, last], LEASES, leases))
    assert found == sorted(
        [
            ("p", 10, "refused", "b", None, None, "a"), ("p", 260, "ignored", "b", None, None, "a"),
            ("p", 500, "released", "a", 0, 3, None), ("p", 505, "ignored", "a", None, None, None),
            ("q", 300, "expired", "a", 0, 1, None),
            # Of the second delivery: the first event came again after the watermark (410 s); the sixth while it waited.
            ("p", 0, "late", "a", None, None, None),
            ("p", 809, "refused", "c", None, None, "b"), ("p", 810, "expired", "b", 510, 1, None),
            ("p", 4000, "late", "d", None, None, None), ("q", 5300, "expired", "a", 5000, 1, None),
        ],
        key=str,
    )


def test_outcomes_do_not_depend_on_the_batches(spark):
    rng = random.Random(3)
    events = [(rng.choice("pq"), rng.choice("abc"), rng.choice(["take", "take", "extend", "release"]), at(i * 45 + rng.randrange(40)), i) for i in range(120)]
    end = [(p, "a", "take", at(10**6), 1000 + i) for i, p in enumerate("pq")]
    whole = outcomes(run_in_batches(spark, [events + end], LEASES, leases))
    shuffled = []
    for i in range(0, 120, 40):  # out of order inside each delivery, and every event of one again in it
        part = events[i : i + 40] + events[i : i + 20]
        rng.shuffle(part)
        shuffled.append(part)
    assert outcomes(run_in_batches(spark, [*shuffled, end], LEASES, leases)) == whole
    assert {o[2] for o in whole} == {"refused", "ignored", "released", "expired"}


class Kept:
    """Handle, state variables and timers of one key; ``calls`` counts the exchanges with the state."""

    def __init__(self):
        self.calls, self.timers, self.watermark, self.most = 0, set(), 0, 0

    def getValueState(self, name, *schema):
        return Variable(self)

    def getListState(self, name, *schema):
        return Variable(self, True)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Variable:
    def __init__(self, kept, listed=False):
        self.kept, self.listed, self.value, self.list, self.map = kept, listed, None, [], {}

    def _called(self, result=None):
        self.kept.calls += 1
        return result

    def get(self):
        return self._called(iter(self.list) if self.listed else self.value)

    def exists(self):
        return self._called(self.value is not None)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value, self.list, self.map = self._called(), [], {}

    def appendValue(self, value):
        self._called(self.list.append(value))

    def put(self, values):
        self.list = self._called(list(values))

    def getValue(self, key):
        return self._called(self.map[key])

    def updateValue(self, key, value):
        self.map[key] = self._called(value)
        self.kept.most = max(self.kept.most, len(json.loads(value[0])))

    def removeKey(self, key):
        self._called(self.map.pop(key))


class Tell(timers.Machine):
    output = "at long, name string"

    def on_event(self, state, at, event):
        return None, [(at, event["name"])]

    def late(self, at, event):
        return [(-at, event["name"])]


def told(batches, part, buffer):
    """What one key gives out for ``batches`` of (events, watermark in ms), and what was kept."""
    processor, kept, out = timers._Ordered(Tell(), ["key"], ["name"]), Kept(), []
    processor.PART, processor.BUFFER = part, buffer
    processor.init(kept)
    for events, watermark in batches:
        given = [Row(__at=at, __id=i, name=name) for at, i, name in events]
        out += [tuple(r)[1:] for r in processor.handleInputRows(("k",), iter(given), kept)] if given else []
        kept.watermark = watermark
        for ms in sorted(t for t in kept.timers if t <= watermark):
            kept.timers.remove(ms)
            out += [tuple(r)[1:] for r in processor.handleExpiredTimer(("k",), kept, None)]
    return out, kept


def test_a_busy_key_waits_in_few_parts():
    rng = random.Random(5)
    events = [(rng.randrange(1, 10**9), str(i), f"n{i}") for i in range(20000)]
    out, kept = told([(events, 10**9)], 512, 4096)
    assert out == [(at, name) for at, _, name in sorted(events, key=lambda e: e[:2])]
    assert kept.calls < 200 and kept.most <= 512


def test_a_quiet_key_is_one_value():
    events = [(at, str(at), f"n{at}") for at in range(1, 61)]
    out, kept = told([(events, 1)], 512, 4096)
    assert out == [(at, name) for at, _, name in events] and kept.calls == 4


def test_runs_give_out_what_waits_in_order():
    rng = random.Random(8)
    for _ in range(200):
        given, batches, expected, waiting, watermark = 0, [], [], {}, 0
        for _ in range(rng.randrange(1, 8)):
            events = []
            for _ in range(rng.randrange(0, 30)):
                events.append((rng.randrange(1, 40) * 500, str(rng.randrange(4)), f"n{given}"))
                given += 1
            if len({e[:2] for e in events}) < len(events):  # of repeats in one batch any may count
                events = list({e[:2]: e for e in events}.values())
            for at, i, name in events:
                if at <= watermark * 1000:
                    expected.append((-at, name))
                else:
                    waiting.setdefault((at, i), name)
            watermark = max(watermark, rng.randrange(0, 22))
            for key in sorted(k for k in waiting if k[0] <= watermark * 1000):
                expected.append((key[0], waiting.pop(key)))
            batches.append((events, watermark))
        out, kept = told(batches, rng.randrange(1, 6), rng.randrange(1, 12))
        assert out == expected
        assert kept.most <= 5


STEPS = ("reset", "shutdown", "end")
HOUR = 3600


def test_states_change_without_events(spark):
    schema = "hostname string, instance_id string, activity string, ts timestamp, event_id long"
    make = lambda s: timers.retirement_changes(s, STEPS, "ts", "event_id", watermark="0 seconds")
    first = [("h", "i", "reset", at(0), 1), ("g", "j", "reset", at(HOUR), 2), ("x", "y", "other", at(10), 3)]
    second = [("h", "i", "shutdown", at(20 * HOUR), 4), ("g", "j", "reset", at(20 * HOUR), 5)]
    third = [("h", "i", "end", at(50 * HOUR), 6), ("z", "z", "other", at(30 * 24 * HOUR), 7)]
    rows = run_in_batches(spark, [first, second, third, [("z", "z", "other", at(31 * 24 * HOUR), 8)]], schema, make)
    found = sorted((r["hostname"], (r["at"] - START).total_seconds() / HOUR, r["state"]) for r in rows)
    assert found == [
        ("g", 1, "ADDED"), ("g", 19, "READY_FOR_MYSQL_SHUTDOWN"), ("g", 20, "ADDED"), ("g", 38, "READY_FOR_MYSQL_SHUTDOWN"), ("g", 20 + 21 * 24, "LEFT"),
        ("h", 0, "ADDED"), ("h", 18, "READY_FOR_MYSQL_SHUTDOWN"), ("h", 20, "MYSQL_SHUTDOWN"), ("h", 38, "READY_FOR_TERMINATION"), ("h", 50, "LEFT"),
    ]


# The keyed table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file://").removeprefix("file:")) for f in names if f.endswith(".parquet"))


KV = "k int, seq int, v string"


def test_a_merge_writes_only_what_it_brings(spark):
    table = KeyedTable(spark, scratch(spark, "kt"), ["k"], ["seq"])
    table.merge(spark.createDataFrame([(i, 1, "a") for i in range(100)], KV))
    before = files(table.path)
    table.merge(spark.createDataFrame([(1, 2, "b"), (1, 3, "c"), (200, 1, "d"), (5, 0, "old"), (6, 1, "tie")], KV))
    added = [f for f in files(table.path) if f not in before]
    assert set(before) <= set(files(table.path))
    assert spark.read.parquet(*["file://" + f for f in added]).count() == 4
    assert rows(table.read().where("k in (1, 5, 6, 200)")) == [(1, 3, "c"), (200, 1, "d"), (5, 1, "a"), (6, 1, "a")]


def test_a_repeated_batch_replaces_its_folder(spark):
    table = KeyedTable(spark, scratch(spark, "kt"), ["k"], ["seq"])
    for number, batch in ((0, [(1, 1, "a")]), (1, [(2, 1, "half")]), (1, [(2, 1, "b"), (3, 1, "c")])):
        table.merge(spark.createDataFrame(batch, KV), number=number, writer="s")
    table.merge(spark.createDataFrame([(9, 1, "z")], KV), number=1, writer="other")
    assert rows(table.read()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (9, 1, "z")]
    table.compact()
    table.merge(spark.createDataFrame([(2, 5, "again")], KV), number=1, writer="s")  # it is in the base
    assert rows(table.read()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (9, 1, "z")]
    table.merge(spark.createDataFrame([(4, 1, "d")], KV), number=3, writer="s")
    table.compact()
    table.merge(spark.createDataFrame([(5, 1, "e")], KV), number=2, writer="s")  # out of order, after a compaction
    assert (4, 1, "d") in rows(table.read()) and (5, 1, "e") in rows(table.read())


def test_ignore_keeps_what_is_there(spark):
    table = KeyedTable(spark, scratch(spark, "kt"), ["k"], ["seq"])
    table.merge(spark.createDataFrame([(1, 1, "a"), (None, 1, "n")], KV), "ignore")
    table.merge(spark.createDataFrame([(1, 5, "b"), (2, 2, "late"), (2, 1, "first"), (None, 9, "m")], KV), "ignore", number=7, writer="w")
    expected = [(1, 1, "a"), (2, 1, "first"), (None, 1, "n")]
    assert rows(table.read()) == sorted(expected, key=str)
    table.merge(spark.createDataFrame([(1, 5, "b"), (2, 2, "late"), (2, 1, "first"), (None, 9, "m")], KV), "ignore", number=7, writer="w")
    assert rows(table.read()) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(1, 1, "a")], KV), "other")


def test_what_dies_halfway_leaves_the_table_as_it_was(spark, monkeypatch):
    table = KeyedTable(spark, scratch(spark, "kt"), ["k"], ["seq"], compact_after=100)
    with pytest.raises(FileNotFoundError):
        table.read()
    for i in range(4):
        table.merge(spark.createDataFrame([(i, 1, "a"), (0, i, f"v{i}")], KV))
    expected, newest = rows(table.read()), table.read()
    broken = spark.createDataFrame([(7, 1, "x")], KV).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken)
    assert rows(table.read()) == expected
    with monkeypatch.context() as m:  # everything is written, and the marker is not
        m.setattr(table, "_mark", lambda marker: (_ for _ in ()).throw(OSError("killed")))
        for step in (table.compact, lambda: table.merge(spark.createDataFrame([(8, 1, "y")], KV))):
            with pytest.raises(OSError):
                step()
    assert rows(table.read()) == expected
    table.compact()
    assert rows(table.read()) == expected == rows(newest)  # one who planned to read the parts still can
    for i in range(3):
        table.merge(spark.createDataFrame([(50 + i, 1, "q")], KV))
    table.compact()
    assert len(rows(table.read())) == len(expected) + 3


def test_compaction_comes_now_and_then(spark):
    table = KeyedTable(spark, scratch(spark, "kt"), ["k"], ["seq"], compact_after=3)
    for i in range(10):
        table.merge(spark.createDataFrame([(i % 4, i, str(i))], KV))
        base, batches = table._current()
        assert len(batches) < 3
    assert base is not None and rows(table.read()) == [(0, 8, "8"), (1, 9, "9"), (2, 6, "6"), (3, 7, "7")]


def test_arrivals_of_more_batches_than_are_remembered(spark):
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "5")  # what a query itself remembers of its batches
    try:
        root = scratch(spark, "many")
        for i in range(12):
            spark.createDataFrame([(at(i * HOUR), "k", i)] * (i + 1), "ts timestamp, kind string, n int").coalesce(1).write.mode("append").parquet(root)
        stream = spark.readStream.schema("ts timestamp, kind string, n int").option("maxFilesPerTrigger", 1).parquet(root)
        table = KeyedTable(spark, scratch(spark, "counted"), ["kind", "start"], ["n"])
        arrived = state.keep_windows(windows.late_metrics(stream, ["kind"], "ts", HOUR, "90 days"), table, scratch(spark, "many-checkpoint"))
    finally:
        spark.conf.set(kept, before)
    assert arrived == sum(range(1, 13)) == table.read().agg(F.sum("n")).first()[0]


# Line diffs


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_line_edits_as_by_the_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(600):
        a, b = ([rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(9))] for _ in range(2))
        edits = line_edits(a, b)
        assert [x for s, x in edits if s != "+"] == a and [x for s, x in edits if s != "-"] == b
        assert sum(s == " " for s, _ in edits) == longest(a, b)
        assert "+-" not in "".join(s for s, _ in edits)
    long = [str(i % 700) for i in range(3000)]
    other = long[:500] + ["x"] + long[600:2500] + long[2400:]
    assert sum(s == " " for s, _ in line_edits(long, other)) == longest(long, other)


def test_moved_lines_show_up(spark):
    seed, moved = "CREATE (\n a\n b\n c\n)", "CREATE (\n b\n c\n a\n)"
    docs = spark.createDataFrame([(seed,), (moved,), (moved,), (None,)], "ddl string")
    found = [(r["sign"], r["line"]) for r in ordered_line_diff(docs, F.lit(seed)).orderBy("place").collect()]
    assert found == [(" ", "CREATE ("), ("-", " a"), (" ", " b"), (" ", " c"), ("+", " a"), (" ", ")")]
    odd = spark.createDataFrame([(None, None), (None, "a"), ("a", ""), ("", "")], "x string, y string")
    made = [[tuple(e) for e in r["edits"]] for r in with_line_edits(odd, F.col("x"), F.col("y")).collect()]
    assert made == [[], [("+", "a")], [("-", "a"), ("+", "")], [(" ", "")]]
