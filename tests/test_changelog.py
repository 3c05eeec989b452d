"""The stream over numbered logs: restarts, rotation, half-written lines, limits."""

from __future__ import annotations

import os

import pytest

from fleetlake.session import scratch
from fleetlake.sources import changelog
from fleetlake.streaming.state import run_available


def plain(path):
    return path.removeprefix("file://").removeprefix("file:")


def append(root, number, data: bytes):
    os.makedirs(plain(root), exist_ok=True)
    with open(f"{plain(root)}/bin.{number:06d}", "ab") as f:
        f.write(data)


class Follow:
    """A stream that is started and stopped, always with the same checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.root, self.options = spark, scratch(spark, "logs"), options
        self.out, self.checkpoint = scratch(spark, "seen"), scratch(spark, "seen-checkpoint")

    def run(self):
        run_available(changelog.stream_change_log(self.spark, self.root, **self.options), self.out, self.checkpoint)
        return self.seen()

    def seen(self):
        return sorted((r.log_number, r.log_offset, r.value) for r in self.spark.read.parquet(self.out).collect())

    def batch(self, **more):
        return sorted((r.log_number, r.log_offset, r.value) for r in changelog.read_change_log(self.spark, self.root, **more).collect())


def test_a_restart_goes_on_at_the_offset(spark):
    follow = Follow(spark, range_bytes=7)
    append(follow.root, 1, b"one\ntwo\nhalf")
    assert follow.run() == [(1, 0, "one"), (1, 4, "two")]
    assert follow.run() == [(1, 0, "one"), (1, 4, "two")]
    append(follow.root, 1, b" done\nthree\n")
    append(follow.root, 2, b"")
    assert follow.run()[2:] == [(1, 8, "half done"), (1, 18, "three")]
    append(follow.root, 2, "vier äé\n".encode())
    append(follow.root, 4, b"\n\nlast line of a log that is over")  # number 3 never was
    assert follow.run()[4:] == [(2, 0, "vier äé"), (4, 0, ""), (4, 1, "")]
    append(follow.root, 5, b"five\n")
    assert follow.run()[7:] == [(4, 2, "last line of a log that is over"), (5, 0, "five")]
    assert follow.seen() == follow.batch() == follow.batch(range_bytes=3)


def test_ranges_of_long_and_short_lines(spark, monkeypatch):
    lines = [("x" * n).encode() for n in (0, 1, 40, 3, 0, 0, 200, 5, 17)]
    follow = Follow(spark)
    append(follow.root, 1, b"\n".join(lines) + b"\n")
    logs = changelog.Logs({"path": plain(follow.root)})
    for block in (4, 64):
        monkeypatch.setattr(changelog, "_BLOCK", block)
        for size in (1, 2, 7, 50, 1000):
            logs.range_bytes = size
            for start in (0, 1, 3, 44):  # offsets behind a line
                parts = logs.ranges({"log": 1, "byte": start}, logs.last())
                found = [v for p in parts for b in logs.read(p) for v in b.column(2).to_pylist()]
                assert "\n".join(found) + "\n" == (b"\n".join(lines) + b"\n")[start:].decode()


def test_short_logs_and_ranges_share_tasks(spark):
    follow = Follow(spark, range_bytes=2)
    for number in range(300):
        append(follow.root, number, b"a%d\nb\nc\n" % number)
    batch = changelog.read_change_log(spark, follow.root, range_bytes=2)
    assert batch.rdd.getNumPartitions() < 350  # 300 logs of 4 or 5 ranges
    expected = [line for n in range(300) for line in ((n, 0, f"a{n}"), (n, 2 + len(str(n)), "b"), (n, 4 + len(str(n)), "c"))]
    assert follow.batch(range_bytes=2) == expected == follow.run()
    long = [changelog.LogRange("x", 1, at, at + 100, 10**9, False) for at in range(0, 10**5, 100)]
    dealt = changelog._dealt(long, 100)
    assert [r for task in dealt for r in task.ranges] == long
    assert max(sum(r.stop - r.start for r in task.ranges) for task in dealt) <= max(100, 10**5 // changelog._TASKS)


def test_batches_are_limited(spark):
    progress = scratch(spark, "progress") + "/at.json"
    follow = Follow(spark, max_bytes=20, progress=progress)
    append(follow.root, 1, b"".join(b"line %02d\n" % i for i in range(10)))
    append(follow.root, 2, b"a line that is longer than the limit is\nb\n")
    stream = changelog.stream_change_log(spark, follow.root, max_bytes=20, progress=progress)
    query = stream.writeStream.format("parquet").option("path", follow.out).option("checkpointLocation", follow.checkpoint).start()
    try:
        query.processAllAvailable()
        rows = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    assert max(rows) <= 3 and len(rows) >= 6 and follow.seen() == follow.batch()
    append(follow.root, 2, b"".join(b"more %02d\n" % i for i in range(10)))
    before = len(follow.seen())
    assert len(follow.run()) == before + 2  # a new start knows where it was, and keeps to the limit
    assert len(follow.run()) == before + 4


def test_lost_and_missing_logs(spark):
    follow = Follow(spark)
    assert follow.batch() == []
    append(follow.root, 7, b"a\nb\n")
    assert follow.run() == [(7, 0, "a"), (7, 2, "b")]
    os.rename(f"{plain(follow.root)}/bin.000007", f"{plain(follow.root)}/gone")
    append(follow.root, 8, b"c\n")
    with pytest.raises(Exception, match="gone"):
        follow.run()
    append(follow.root, 7, b"a\nb\n")
    assert follow.run() == [(7, 0, "a"), (7, 2, "b"), (8, 0, "c")]
