"""Numbered log files of text lines as a stream with offsets of its own.

An offset is a log's number and a byte in it, always behind a finished line. What a batch holds are the bytes
between two offsets, over as many logs as lie between; they are cut into ranges, and a range yields the lines that begin in it, so
a long log is read by many tasks. The newest log may end in a line that is still being written: that is left
for later. A log with a successor is finished, and so is its last line, with or without a line feed. A restarted query
goes on at the offset it had committed to, and a batch that is run again finds the same bytes.

``maxbytes`` limits what one batch takes in (at least a line). Spark asks for the end of the first batch before it tells where that
starts, so for the limit to hold from there the source notes what was committed in a ``progress`` file; without one the first
batch after each start takes all there is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import qualified
from .records import RANGE_BYTES, _file_system

FORMAT = "fleet_changelog"
PATTERN = r"\.(\d+)$"
_BLOCK = 1 << 20
_TASKS = 192


class LogRange(InputPartition):
    """Lines of log ``number`` that begin in bytes [start, stop); none reaches beyond ``end``."""

    def __init__(self, path: str, number: int, start: int, stop: int, end: int, first: bool):
        self.path, self.number, self.start, self.stop, self.end, self.first = path, number, start, stop, end, first


class LogRanges(InputPartition):
    """What one task reads: ranges one after the other."""

    def __init__(self, ranges: list[LogRange]):
        self.ranges = ranges


def _dealt(ranges: list[LogRange], range_bytes: int) -> list[InputPartition]:
    """Ranges dealt out to tasks, so that many short logs and ranges do not make as many tasks.

    A task takes in the ``_TASKS``-th part of all bytes, but no less than a range and no more than ``RANGE_BYTES`` (or one range).
    """
    share = max(range_bytes, min(RANGE_BYTES, sum(part.stop - part.start for part in ranges) // _TASKS))
    tasks: list[InputPartition] = []
    taken = share
    for part in ranges:
        size = part.stop - part.start
        if taken + size > share:
            tasks.append(LogRanges([]))
            taken = 0
        tasks[-1].ranges.append(part)
        taken += size
    return tasks or [LogRanges([])]


def _line_end(handle, start: int, end: int) -> int:
    """The byte behind the first line feed from ``start`` on, or ``end``."""
    at = start
    while at < end:
        handle.seek(at)
        block = handle.read(min(_BLOCK, end - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return end


def _last_line_end(handle, start: int, end: int) -> int:
    """The byte behind the last line feed ahead of ``end``, or ``start``."""
    at = end
    while at > start:
        low = max(start, at - _BLOCK)
        handle.seek(low)
        found = handle.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


class Logs:
    """The logs of a folder, by number."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pattern = re.compile(options.get("pattern", PATTERN))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def found(self) -> dict[int, tuple[str, int]]:
        from pyarrow import fs

        system, root = _file_system(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        logs = {}
        for info in infos:
            name = re.search(self.pattern, info.path)
            if info.type == fs.FileType.File and name:
                number = int(name[1])
                if number in logs:
                    raise ValueError(f"log {number} is in two files: {logs[number][0]} and {info.path}")
                logs[number] = info.path, info.size
        return logs

    def first(self) -> dict:
        return {"log": min(self.found(), default=0), "byte": 0}

    def last(self, after: dict | None = None, most: int | None = None) -> dict:
        """The end of what is finished; with ``after`` and ``most`` at most about so many bytes on."""
        logs = self.found()
        if not logs:
            return after or {"log": 0, "byte": 0}
        newest = max(logs)
        system, _ = _file_system(self.path)
        if most is not None and after is not None:
            left = most
            for number in sorted(n for n in logs if n >= after["log"]):
                path, size = logs[number]
                start = after["byte"] if number == after["log"] else 0
                if size - start > left:
                    with system.open_input_file(path) as handle:
                        end = _last_line_end(handle, start, start + left)
                        end = end if end > start else _line_end(handle, start, size)
                        if number < newest or _last_line_end(handle, start, size) >= end:
                            return {"log": number, "byte": end}
                    break
                left -= size - start
        path, size = logs[newest]
        start = after["byte"] if after and after["log"] == newest else 0
        with system.open_input_file(path) as handle:
            return {"log": newest, "byte": _last_line_end(handle, min(start, size), size)}

    def ranges(self, start: dict, end: dict) -> list[LogRange]:
        logs = self.found()
        out = []
        if start == end:
            return out
        if start["log"] not in logs and start["byte"]:
            raise FileNotFoundError(f"log {start['log']} of {self.path} is gone, and was not read beyond byte {start['byte']}")
        for number in sorted(n for n in logs if start["log"] <= n <= end["log"]):
            path, size = logs[number]
            low = start["byte"] if number == start["log"] else 0
            high = end["byte"] if number == end["log"] else size
            out += [
                LogRange(path, number, at, min(at + self.range_bytes, high), high, at == low) for at in range(low, high, self.range_bytes)
            ]
        return out

    def tasks(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(self.ranges(start, end), self.range_bytes)

    def read(self, part: LogRange) -> Iterator:
        import pyarrow as pa

        system, _ = _file_system(self.path)
        with system.open_input_file(part.path) as handle:
            # A line that began ahead of the range belongs to the one before.
            at = part.start if part.first else _line_end(handle, part.start - 1, part.end)
            while at < part.stop:
                handle.seek(at)
                block = handle.read(min(_BLOCK, part.end - at))
                if at + len(block) < part.end and block.rfind(b"\n") < 0:  # a line longer than the block
                    end = _line_end(handle, at + len(block), part.end)
                    handle.seek(at)
                    block = handle.read(end - at)
                whole = block[: block.rfind(b"\n") + 1] if at + len(block) < part.end else block
                lines = whole.split(b"\n")
                if not lines[-1]:
                    lines.pop()
                places, own = [], at
                for line in lines:
                    if own >= part.stop:
                        break
                    places.append(own)
                    own += len(line) + 1
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.number] * n, pa.int64()), pa.array(places, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines[:n]])],
                    names=["log_number", "log_offset", "value"],
                )
                at += len(whole)


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.logs = Logs(options)

    def partitions(self):
        return self.logs.tasks(self.logs.first(), self.logs.last())

    def read(self, partition):
        for part in partition.ranges:
            yield from self.logs.read(part)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.logs, self.progress = Logs(options), options.get("progress")
        self.most = int(options["maxbytes"]) if "maxbytes" in options else None
        self.planned: dict | None = self._known()

    def _known(self) -> dict | None:
        from pyarrow import fs

        if self.progress:
            system, path = _file_system(self.progress)
            if system.get_file_info(path).type == fs.FileType.File:
                with system.open_input_file(path) as handle:
                    return json.loads(handle.read())
            return self.logs.first()  # nothing was committed yet
        return None

    def initialOffset(self):
        self.planned = self.logs.first()
        return self.planned

    def latestOffset(self):
        return self.logs.last(self.planned, self.most)

    def partitions(self, start, end):
        self.planned = end
        return self.logs.tasks(start, end)

    def read(self, partition):
        for part in partition.ranges:
            yield from self.logs.read(part)

    def commit(self, end):
        if self.progress:
            system, path = _file_system(self.progress)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(json.dumps(end).encode())


class LogSource(DataSource):
    """``format("fleet_changelog")``: (log_number, log_offset, value) per line of the logs in a folder, in batch or as a stream.

    Options: path, pattern (finds a log's number in its path), rangebytes, maxbytes, progress.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "log_number bigint, log_offset bigint, value string"

    def reader(self, schema):
        return LogReader(dict(self.options))

    def streamReader(self, schema):
        return LogStreamReader(dict(self.options))


def _with_options(reader, spark: SparkSession, path: str, options: dict):
    spark.dataSource.register(LogSource)
    given = {k: v for k, v in options.items() if v is not None}
    if "progress" in given:
        given["progress"] = qualified(spark, given["progress"])
    return reader.format(FORMAT).options(**given).option("path", qualified(spark, path))


def read_change_log(spark: SparkSession, path: str, pattern: str = PATTERN, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The finished lines of all logs in a folder: (log_number, log_offset, value)."""
    return _with_options(spark.read, spark, path, {"pattern": pattern, "rangebytes": str(range_bytes)}).load()


def stream_change_log(
    spark: SparkSession, path: str, pattern: str = PATTERN, range_bytes: int = RANGE_BYTES, max_bytes: int | None = None, progress: str | None = None
) -> DataFrame:
    """The same as a stream, that goes on as lines are added and logs change."""
    options = {"pattern": pattern, "rangebytes": str(range_bytes), "maxbytes": str(max_bytes) if max_bytes else None, "progress": progress}
    return _with_options(spark.readStream, spark, path, options).load()
