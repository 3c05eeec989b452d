"""Keyed state machines over event streams, driven by event-time timers.

A machine sees the events of a key in the order of their times, whatever order they arrive in: events wait in
the key's state until the watermark has passed them. It also names the next moment at which something
happens without an event (an expiry, a waiting time that ends); a timer wakes the key then. So what comes out
depends on the events alone, not on how they were cut into batches.

An event that repeats one that still waits is dropped by its id. One that is later than the watermark, which is
also what a repeat of a past event is, goes to ``late``. State is what waits and one small row per key, and a key
without either has none. A key's events are taken one after the other, which is what a state machine is; keys
are spread over the tasks.

Times are TIMESTAMP in the stream and microseconds since 1970 inside a machine.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.lifecycle import LEASE_SECONDS, QUEUE_DAYS, SETTLE_HOURS
from .windows import event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECOND = 1_000_000


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams may keep state of their own with timers."""
    session = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(_PROVIDER, _ROCKS)
    return session


class Machine:
    """What happens to one key. Its state is a dict of plain values, or None."""

    #: Fields of the rows it gives out, besides the key.
    output = ""

    def due(self, state: dict | None) -> int | None:
        """The next moment at which something happens without an event."""
        return None

    def on_due(self, state: dict | None, at: int) -> tuple[dict | None, list[tuple]]:
        return state, []

    def on_event(self, state: dict | None, at: int, event: dict) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def late(self, at: int, event: dict) -> list[tuple]:
        """Rows for an event that came after the watermark; none by default."""
        return []


class _Ordered(StatefulProcessor):
    """Up to ``PART`` waiting events lie beside the machine's state. More are written as a sorted run, which is cut into parts.

    Those that are ready are merged out of the runs, a part of each at a time. So a quiet key costs one value, a busy one
    a call per part instead of one per event, and never has all its events in memory.
    """

    PART, BUFFER = 512, 65536

    def __init__(self, machine: Machine, keys: Sequence[str], fields: Sequence[str]) -> None:
        self.machine, self.fields = machine, list(fields)
        self.row = Row(*keys, *[field.split()[0] for field in machine.output.split(", ")])

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "run long, part long", "events string")
        self.state = handle.getValueState("state", "state string, runs string, few string")

    def _load(self) -> tuple[dict | None, list[dict], list[list]]:
        """The machine's state, the runs (of each its number, the parts [low, high) and its first time) and the few events beside."""
        held = self.state.get()
        return tuple(json.loads(x) for x in held) if held is not None else (None, [], [])

    def _save(self, state: dict | None, runs: list[dict], few: list[list]) -> None:
        if state is None and not runs and not few:
            self.state.clear()
        else:
            self.state.update(tuple(json.dumps(x) for x in (state, runs, few)))

    def _add(self, runs: list[dict], few: list[list], more: dict[tuple[int, str], list]) -> list[list]:
        """The few events beside the state, with ``more`` by (at, id) among them, or none if all became a run."""
        events = more | {(at, i): values for at, i, values in few}
        ordered = [[at, i, values] for (at, i), values in sorted(events.items())]
        if len(ordered) <= self.PART:
            return ordered
        number, high = (runs[-1]["run"] + 1 if runs else 0), 0
        for start in range(0, len(ordered), self.PART):
            self.parts.updateValue((number, high), (json.dumps(ordered[start : start + self.PART]),))
            high += 1
        runs.append({"run": number, "low": 0, "high": high, "first": ordered[0][0]})
        return []

    def _taken(self, run: dict, passed: int) -> Iterator[tuple]:
        """The events of a run up to ``passed``, which leave the state."""
        while run["low"] < run["high"]:
            events = json.loads(self.parts.getValue((run["run"], run["low"]))[0])
            n = bisect_right(events, passed, key=lambda event: event[0])
            for at, i, values in events[:n]:
                yield at, i, run["run"], values
            if n < len(events):
                run["first"] = events[n][0]
                if n:
                    self.parts.updateValue((run["run"], run["low"]), (json.dumps(events[n:]),))
                return
            self.parts.removeKey((run["run"], run["low"]))
            run["low"] += 1

    def _ready(self, runs: list[dict], few: list[list], passed: int) -> Iterator[tuple[int, dict]]:
        """The events of the runs up to ``passed`` and ``few`` in order; of repeats the one that came first."""
        sorted_ = [self._taken(run, passed) for run in runs if run["first"] <= passed]
        last, beside = None, runs[-1]["run"] + 1 if runs else 0
        for at, i, _, values in heapq.merge(*sorted_, ((at, i, beside, values) for at, i, values in few)):
            if (at, i) != last:
                last = at, i
                yield at, dict(zip(self.fields, values))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state, runs, few = self._load()
        waits = min([run["first"] for run in runs] + [event[0] for event in few[:1]], default=None)
        more: dict[tuple[int, str], list] = {}
        first = None
        for row in rows:
            at = row["__at"]
            if at <= passed:
                for values in self.machine.late(at, {f: row[f] for f in self.fields}):
                    yield self.row(*key, *values)
                continue
            more[at, row["__id"]] = [row[f] for f in self.fields]
            first = at if first is None else min(first, at)
            if len(more) >= self.BUFFER:
                few, more = self._add(runs, few, more), {}
        if first is not None:
            self._save(state, runs, self._add(runs, few, more))
            # The timer that is set is never later than what waits, so only a new first event needs one.
            if waits is None or first < waits:
                self._wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state, runs, few = self._load()
        n = bisect_right(few, passed, key=lambda event: event[0])
        for at, event in chain(self._ready(runs, few[:n], passed), [(passed, None)]):
            while (due := self.machine.due(state)) is not None and due <= at:
                state, made = self.machine.on_due(state, due)
                for values in made:
                    yield self.row(*key, *values)
            if event is not None:
                state, made = self.machine.on_event(state, at, event)
                for values in made:
                    yield self.row(*key, *values)
        runs, few = [run for run in runs if run["low"] < run["high"]], few[n:]
        self._save(state, runs, few)
        following = [self.machine.due(state), *[run["first"] for run in runs], *[event[0] for event in few[:1]]]
        if any(x is not None for x in following):
            self._wake(min(x for x in following if x is not None))

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def run_machine(
    stream: DataFrame, keys: Sequence[str], ts: str, event_id: str, fields: Sequence[str], machine: Machine, watermark: str
) -> DataFrame:
    """What ``machine`` makes of the events of each key; ``fields`` are the columns it looks at.

    The stream has to come from a ``stateful_session``.
    """
    timed = event_time(stream, ts, watermark)
    # Without the time column itself Spark leaves late rows in, for the machine to tell of.
    given = timed.select(
        *keys, *fields, F.unix_micros(ts).alias("__at"), F.coalesce(F.col(event_id).cast("string"), F.lit("")).alias("__id")
    )
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return given.groupBy(*keys).transformWithState(
        statefulProcessor=_Ordered(machine, keys, fields), outputStructType=f"{kinds}, {machine.output}", outputMode="Append", timeMode="EventTime"
    )


class Leases(Machine):
    """Leases with one holder at a time.

    ``take`` is granted if nobody holds the lease, renews it for its holder, and is refused otherwise; ``extend`` renews it for its
    holder; ``release`` ends it. Without either, it expires. An ``extend`` or ``release`` of one who does not hold it is
    ``ignored``. A lease is given out when it ends (``released`` or ``expired``); late events as ``late``.
    """

    output = "holder string, at long, outcome string, lease_start long, last_seen long, n_events long, held_by string"

    def __init__(self, seconds: int = LEASE_SECONDS, holder: str = "holder", kind: str = "kind") -> None:
        self.length, self.holder, self.kind = seconds * _SECOND, holder, kind

    def due(self, state: dict | None) -> int | None:
        return state["last"] + self.length if state else None

    def _ended(self, state: dict, at: int, outcome: str) -> list[tuple]:
        return [(state["holder"], at, outcome, state["start"], state["last"], state["n"], None)]

    def on_due(self, state: dict | None, at: int) -> tuple[dict | None, list[tuple]]:
        return None, self._ended(state, at, "expired")

    def on_event(self, state: dict | None, at: int, event: dict) -> tuple[dict | None, list[tuple]]:
        holder, kind = event[self.holder], event[self.kind]
        if state is None:
            if kind == "take":
                return {"holder": holder, "start": at, "last": at, "n": 1}, []
            return None, [(holder, at, "ignored", None, None, None, None)]
        if holder != state["holder"]:
            outcome = "refused" if kind == "take" else "ignored"
            return state, [(holder, at, outcome, None, None, None, state["holder"])]
        state = state | {"last": at, "n": state["n"] + 1}
        return (None, self._ended(state, at, "released")) if kind == "release" else (state, [])

    def late(self, at: int, event: dict) -> list[tuple]:
        return [(event[self.holder], at, "late", None, None, None, None)]


class Retirement(Machine):
    """States of a server in the retirement queue, given out as they change: (at, state, happened).

    ADDED by the first step and MYSQL_SHUTDOWN by the second; READY_FOR_MYSQL_SHUTDOWN and READY_FOR_TERMINATION 18 hours after
    those; LEFT three weeks after them, or by the third step. A step's last time counts.
    """

    output = "at long, state string, happened long"
    SETTLE, LEAVE = SETTLE_HOURS * 3600 * _SECOND, QUEUE_DAYS * 86400 * _SECOND

    def __init__(self, activities: Sequence[str], activity: str = "activity") -> None:
        self.activities, self.activity = list(activities), activity

    def _now(self, state: dict, at: int) -> tuple[str, int | None]:
        reset, shutdown, terminate = (state["steps"].get(a) for a in self.activities)
        since = reset if shutdown is None else shutdown
        if since is None or since <= at - self.LEAVE or (shutdown is not None and terminate is not None):
            return "LEFT", None
        recent = since > at - self.SETTLE
        if shutdown is None:
            return ("ADDED" if recent else "READY_FOR_MYSQL_SHUTDOWN"), since
        return ("MYSQL_SHUTDOWN" if recent else "READY_FOR_TERMINATION"), since

    def _changed(self, state: dict, at: int) -> tuple[dict, list[tuple]]:
        now = list(self._now(state, at))
        if now == state["told"]:
            return state | {"seen": at}, []
        return state | {"told": now, "seen": at}, [(at, *now)]

    def due(self, state: dict | None) -> int | None:
        if not state or state["told"][1] is None:
            return None
        since = state["told"][1]
        return next((x for x in (since + self.SETTLE, since + self.LEAVE) if x > state["seen"]), None)

    def on_due(self, state: dict | None, at: int) -> tuple[dict | None, list[tuple]]:
        return self._changed(state, at)

    def on_event(self, state: dict | None, at: int, event: dict) -> tuple[dict | None, list[tuple]]:
        state = state or {"steps": {}, "told": ["LEFT", None], "seen": at}
        if event[self.activity] not in self.activities:
            return (state if state["steps"] else None), []
        return self._changed(state | {"steps": state["steps"] | {event[self.activity]: at}}, at)


def lease_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, event_id: str, holder: str = "holder", kind: str = "kind",
    seconds: int = LEASE_SECONDS, watermark: str = "10 minutes",
) -> DataFrame:
    """(keys, holder, at, outcome, lease_start, last_seen, n_events, held_by) of leases on ``keys``; see ``Leases``."""
    made = run_machine(stream, keys, ts, event_id, [holder, kind], Leases(seconds, holder, kind), watermark)
    return _with_times(made, ["at", "lease_start", "last_seen"])


def retirement_changes(
    stream: DataFrame, activities: Sequence[str], ts: str, event_id: str, keys: Sequence[str] = ("hostname", "instance_id"),
    activity: str = "activity", watermark: str = "10 minutes",
) -> DataFrame:
    """(keys, at, state, happened): every change of a server's state in the retirement queue; see ``Retirement``."""
    made = run_machine(stream, keys, ts, event_id, [activity], Retirement(activities, activity), watermark)
    return _with_times(made, ["at", "happened"])


def _with_times(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Microseconds as timestamps without zone, in UTC."""
    seconds = {c: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(c).cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")) for c in columns}
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumns({c: epoch + s for c, s in seconds.items()})
