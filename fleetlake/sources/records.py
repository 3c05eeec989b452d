"""Delimited dumps and text files as a splittable Spark data source.

Files are cut into byte ranges. A record of a dump ends at a line feed before which there is
an even run of backslashes, so any range finds its first record on its own by looking at the
bytes around its start. Inside a task whole blocks of bytes are handled at once, with bytes
methods and Arrow kernels; types are given by column expressions.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import typed_field
from ..session import qualified

FORMAT = "fleet_records"
RANGE_BYTES = 128 * 1024 * 1024
_BLOCK = 4 * 1024 * 1024
_BATCH_BYTES = 8 * 1024 * 1024
_COMPRESSED = {".gz": "gzip", ".zst": "zstd", ".bz2": "bz2"}


class ByteRange(InputPartition):
    """Bytes [start, stop) of one file; ``stop`` is None for a file read as one stream."""

    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


def _file_system(path: str):
    """Arrow file system and plain path of a path or URI as Spark writes them."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # Hadoop's names for S3 clients are all plain S3 here.
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


# Inside a task, an escaped backslash, tab or line feed is written as a backslash and one of
# these, so that what is left of tabs and line feeds are borders. Lengths stay the same.
_STAND_INS = [(b"\\\\", b"\\\x01"), (b"\\\t", b"\\\x02"), (b"\\\n", b"\\\x03")]
# Escapes and what they stand for. Any other escaped character is itself.
_ESCAPES = {
    b"\\\x02": b"\t",
    b"\\\x03": b"\n",
    b"\\0": b"\0",
    b"\\t": b"\t",
    b"\\n": b"\n",
    b"\\r": b"\r",
    b"\\b": b"\b",
    b"\\Z": b"\x1a",
}
_OTHER_ESCAPE = re.compile(rb"\\([^\x01])", re.DOTALL)
# An odd run of backslashes ahead of a stand-in's byte: an escape that cannot be told from one.
_AMBIGUOUS = re.compile(rb"(?<!\\)(?:\\\\)*\\[\x01-\x03]")


def _trailing_backslashes(piece: bytes) -> int:
    return len(piece) - len(piece.rstrip(b"\\")) if piece.endswith(b"\\") else 0


def _odd_run_before(handle, position: int) -> bool:
    """Whether an odd run of backslashes ends just before ``position``."""
    run = 0
    while position > 0:
        size = min(4096, position)
        handle.seek(position - size)
        piece = handle.read(size)
        here = _trailing_backslashes(piece)
        run += here
        if here < size:
            break
        position -= size
    return run % 2 == 1


def _borders_marked(block: bytes, lead: bool) -> bytes:
    """The block with escaped borders replaced by their stand-ins.

    ``lead`` says that the block's first byte is escaped by what came before it.
    """
    first, rest = (block[:1], block[1:]) if lead else (b"", block)
    if b"\\" in rest:
        if any(mark in rest for _, mark in _STAND_INS) and _AMBIGUOUS.search(rest):
            raise ValueError("the dump escapes control bytes 1 to 3, which no dump writer does")
        for escaped, mark in _STAND_INS:
            rest = rest.replace(escaped, mark)
    if first == b"\n":
        first = b"\x03"
    return first + rest


def read_records(
    handle, start: int, escaped: bool, lead: bool = False, block_bytes: int = _BLOCK
) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, consecutive records) from the current position of ``handle``, which is ``start``.

    ``lead`` says that an odd run of backslashes came just before it. Records of a dump hold
    stand-ins; their lengths are those in the file.
    """
    offset, kept, tail = start, [], b""
    while True:
        block = handle.read(block_bytes)
        last = not block
        block = tail + block
        tail = b""
        if escaped and not last:
            # An escape that the block's end cuts in two waits for the next block.
            run = _trailing_backslashes(block)
            if (run + (lead and run == len(block))) % 2:
                block, tail = block[:-1], block[-1:]
        if escaped and block:
            block = _borders_marked(block, lead)
            lead = False
        pieces = block.split(b"\n")
        kept.append(pieces[0])
        if len(pieces) > 1:
            pieces[0] = b"".join(kept)
            kept = [pieces.pop()]
            yield offset, pieces
            offset += sum(map(len, pieces)) + len(pieces)
        if last:
            rest = b"".join(kept)
            if rest:
                yield offset, [rest]
            return


def _unescaped(values):
    """Arrow array of raw fields, unescaped; ``\\N`` is null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    null = pc.equal(values, pa.scalar(b"\\N", pa.binary()))
    if pc.any(pc.match_substring(values, b"\\")).as_py():
        for escape, plain in _ESCAPES.items():
            if pc.any(pc.match_substring(values, escape)).as_py():
                values = pc.replace_substring(values, escape, plain)
        others = pc.and_not(pc.match_substring_regex(values, r"\\[^\x01]"), null)
        if pc.any(others).as_py():
            values = pa.array([_OTHER_ESCAPE.sub(rb"\1", v) for v in values.to_pylist()], pa.binary())
        values = pc.replace_substring(values, b"\\\x01", b"\\")
    return pc.if_else(null, pa.scalar(None, pa.binary()), values)


def split_fields(records):
    """Arrow array of raw records to a list array of unescaped fields; ``\\N`` is null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(records, b"\t")
    return pa.ListArray.from_arrays(lists.offsets, _unescaped(lists.flatten()))


def split_columns(records, keep: Sequence[int]):
    """Arrow arrays of the fields numbered in ``keep``, unescaped; the other fields are only passed over."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(records, b"\t")
    return [_unescaped(pc.list_element(lists, i)) for i in keep]


def range_records(handle, start: int, stop: int, escaped: bool, block_bytes: int = _BLOCK):
    """(offset, records) lists of the records that begin in [start, stop)."""
    begin = max(start - 1, 0)
    lead = start > 0 and escaped and _odd_run_before(handle, begin)
    handle.seek(begin)
    # The bytes up to the first border belong to the range before.
    skip = start > 0
    for offset, records in read_records(handle, begin, escaped, lead, block_bytes):
        if skip:
            offset += len(records[0]) + 1
            records, skip = records[1:], False
        end = offset + sum(map(len, records)) + len(records)
        if end > stop:
            # Only the last list reaches past the end: drop the records that begin there.
            inside, at = 0, offset
            while inside < len(records) and at < stop:
                at += len(records[inside]) + 1
                inside += 1
            records = records[:inside]
            if records:
                yield offset, records
            return
        if records:
            yield offset, records


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.escaped = str(options.get("escaped", "true")).lower() == "true"
        self.markers = str(options.get("markers", "false")).lower() == "true"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def _files(self):
        from pyarrow import fs

        for root in self.path.split(","):
            system, path = _file_system(root)
            prefix = root[: len(root) - len(path)] if root.endswith(path) else ""
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            if info.type == fs.FileType.File:
                found = [info]
            else:
                found = system.get_file_info(fs.FileSelector(path, recursive=True))
            for item in found:
                # Files and folders whose name begins with "_" or "." hold no data.
                below = item.path[len(path) :].strip("/") or item.base_name
                hidden = any(name[0] in "_." for name in below.split("/"))
                if item.type == fs.FileType.File and item.size and hidden == self.markers:
                    yield prefix + item.path, item.size

    def partitions(self) -> Sequence[InputPartition]:
        ranges = []
        for path, size in self._files():
            if os.path.splitext(path)[1] in _COMPRESSED:
                ranges.append(ByteRange(path, 0, None))
                continue
            for start in range(0, size, self.range_bytes):
                ranges.append(ByteRange(path, start, min(start + self.range_bytes, size)))
        return ranges or [InputPartition(None)]

    def _records(self, part: ByteRange):
        """(offset, records) lists of one range."""
        system, path = _file_system(part.path)
        if part.stop is None:
            codec = _COMPRESSED[os.path.splitext(path)[1]]
            with system.open_input_stream(path, compression=codec) as stream:
                yield from read_records(stream, 0, self.escaped)
            return
        with system.open_input_file(path) as handle:
            yield from range_records(handle, part.start, part.stop, self.escaped)

    def read(self, partition: ByteRange):
        import numpy as np
        import pyarrow as pa

        if not isinstance(partition, ByteRange):
            # Without any file there are no ranges to read.
            return
        names = ["path", "start", "fields"] if self.escaped else ["path", "start", "range_start", "seq", "value"]
        seq = 0
        for offset, records in self._records(partition):
            steps = np.fromiter(map(len, records), dtype=np.int64, count=len(records)) + 1
            starts = offset + np.cumsum(steps) - steps
            # Batches are cut by size, so that long records do not pile up.
            cuts = np.searchsorted(np.cumsum(steps), np.arange(_BATCH_BYTES, steps.sum(), _BATCH_BYTES))
            for low, high in zip([0, *cuts + 1], [*cuts + 1, len(records)]):
                if low >= high:
                    continue
                n = high - low
                values = pa.array(records[low:high], pa.binary())
                columns = [pa.array([partition.path] * n, pa.string()), pa.array(starts[low:high])]
                if self.escaped:
                    columns.append(split_fields(values))
                else:
                    place = [np.full(n, partition.start, dtype=np.int64), np.arange(seq, seq + n, dtype=np.int64)]
                    columns += [*map(pa.array, place), values]
                    seq += n
                yield pa.RecordBatch.from_arrays(columns, names=names)


class RecordSource(DataSource):
    """``format("fleet_records")``: (path, start, fields) per dump record, or, without the option
    ``escaped``, (path, start, range_start, seq, value) per line, ``seq`` counting from 0 in each range."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        escaped = str(self.options.get("escaped", "true")).lower() == "true"
        return "path string, start bigint, " + (
            "fields array<binary>" if escaped else "range_start bigint, seq bigint, value binary"
        )

    def reader(self, schema):
        return RecordReader(self.options)


def _records_frame(
    spark: SparkSession, path: str, escaped: bool, range_bytes: int = RANGE_BYTES, markers: bool = False
) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return (
        spark.read.format(FORMAT)
        .option("escaped", str(escaped).lower())
        .option("markers", str(markers).lower())
        .option("rangebytes", str(range_bytes))
        .load(",".join(qualified(spark, root) for root in path.split(",")))
    )


def read_dump(
    spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Rows of a tab-separated, backslash-escaped dump, typed by ``schema``."""
    records = _records_frame(spark, path, True, range_bytes)
    return records.select(
        *[typed_field(F.col("fields")[i], f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    )


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, range_start, seq, line) of text files; ``start`` is the byte offset of a line."""
    records = _records_frame(spark, path, False, range_bytes)
    return records.withColumn("value", F.decode("value", "UTF-8")).withColumnRenamed("value", "line")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the marker files below a folder, which data readers pass over."""
    return _records_frame(spark, path, False, markers=True).select("path").distinct()


def number_lines(lines: DataFrame, by_folder: bool = False) -> DataFrame:
    """(path, line_no, line), numbered from 0 per file without gaps.

    With ``by_folder`` the files of a folder are one text, in the order of their names. Lines know their
    number within the range they were read from. The ranges of a text are
    counted and summed up, one row each, and added back: the lines themselves are not shuffled.
    """
    text = F.regexp_extract("path", "^(.*)/", 1) if by_folder else F.col("path")
    counts = lines.groupBy("path", "range_start").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(text).orderBy("path", "range_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("path", "range_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.join(before, ["path", "range_start"])
    return numbered.select("path", (F.col("before") + F.col("seq")).alias("line_no"), "line")


def zip_lines(first: DataFrame, second: DataFrame, on: str = "line_no") -> DataFrame:
    """Line i of one file with line i of the other, up to the shorter file: (line_no, a, b)."""
    a = first.select(on, F.col("line").alias("a"))
    return a.join(second.select(on, F.col("line").alias("b")), on)
