"""Escapes, dump records and byte ranges."""

from __future__ import annotations

import hashlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.functions.moments import moment
from fleetlake.functions.text import ONE_BYTE, null_escape
from fleetlake.queries import files
from fleetlake.session import scratch
from fleetlake.sinks.export import export_table
from fleetlake.sources.records import _file_system, number_lines, range_records, read_dump, read_lines, read_records, split_fields

VECTORS = [
    ("5c30", "00"),
    ("5c5c30", "5c5c30"),
    ("5c5c5c30", "5c5c00"),
    ("5c5c5c5c30", "5c5c5c5c30"),
    ("5c5c5c3030", "5c5c0030"),
    ("5c5c5c5c3030", "5c5c5c5c3030"),
    ("5c5c5c40", "5c5c5c40"),
    ("5c5c5c5c40", "5c5c5c5c40"),
    # an odd run at the end stays
    ("415c5c5c", "415c5c5c"),
    (
        "3109646174613109 30205c090d5c0a22275c305c5c3009322e320a",
        "3109646174613109 30205c090d5c0a2227005c5c3009322e320a",
    ),
]


def test_null_escape(spark):
    rows = [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in VECTORS]
    df = spark.createDataFrame(rows, "a binary, b binary")
    got = df.select(F.encode(null_escape(F.decode("a", ONE_BYTE)), ONE_BYTE).alias("g"), "b").collect()
    assert [bytes(r.g) for r in got] == [bytes(r.b) for r in got]


def split_slowly(data: bytes, escaped: bool):
    """Record borders by reading one byte after the other."""
    records, start, escape = [], 0, False
    for i, byte in enumerate(data):
        if escaped and escape:
            escape = False
        elif escaped and byte == 0x5C:
            escape = True
        elif byte == 0x0A:
            records.append((start, data[start:i]))
            start = i + 1
    if start < len(data):
        records.append((start, data[start:]))
    return records


@pytest.mark.parametrize("escaped", [True, False])
def test_ranges_cover_every_record_once(escaped):
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"\\\\\\\nab\t") for _ in range(rng.randint(1, 60)))
        if not data.endswith(b"\n"):
            data += b"\n" if data.endswith(b"\n") or not data.endswith(b"\\") else b"x\n"
        step, block = rng.randint(1, 9), rng.randint(1, 11)
        got = []
        for start in range(0, len(data), step):
            stop = min(start + step, len(data))
            for offset, records in range_records(io.BytesIO(data), start, stop, escaped, block):
                for record in records:
                    got.append((offset, data[offset : offset + len(record)]))
                    offset += len(record) + 1
        assert got == split_slowly(data, escaped), data


def unescape_slowly(field: bytes):
    if field == b"\\N":
        return None
    named = {b"0": b"\0", b"t": b"\t", b"n": b"\n", b"r": b"\r", b"b": b"\b", b"Z": b"\x1a"}
    out, i = [], 0
    while i < len(field):
        byte = field[i : i + 1]
        if byte == b"\\" and i + 1 < len(field):
            i += 1
            byte = named.get(field[i : i + 1], field[i : i + 1])
        out.append(byte)
        i += 1
    return b"".join(out)


def fields_slowly(record: bytes):
    fields, escape = [b""], False
    for byte in (record[i : i + 1] for i in range(len(record))):
        if byte == b"\t" and not escape:
            fields.append(b"")
        else:
            fields[-1] += byte
        escape = byte == b"\\" and not escape
    return [unescape_slowly(f) for f in fields]


def test_fields_of_random_records():
    rng = random.Random(21)
    pieces = [b"\\\\", b"\\\t", b"\\\n", b"\\0", b"\\N", b"\\q", b"\\t", b"\t", b"\t", b"a", b"N", b"\xff", b"\0", b"\xc3\xa9"]
    data = b"".join(b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) + b"\n" for _ in range(500))
    got = []
    for _, records in read_records(io.BytesIO(data), 0, True, block_bytes=50):
        got += split_fields(pa.array(records, pa.binary())).to_pylist()
    assert got == [fields_slowly(r) for _, r in split_slowly(data, True)]


def test_escaped_control_bytes_are_refused():
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(b"a\\\x01b\n"), 0, True))


def test_dump_round_trip(spark):
    rng = random.Random(3)
    alphabet = ["\\", "\t", "\n", "\0", "N", "0", "t", "é", "漢", "\r", '"', "'", "\b", "\x1a"]
    rows = []
    for i in range(400):
        text = None if i % 17 == 0 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        blob = None if i % 13 == 0 else bytes(rng.randrange(256) for _ in range(rng.randint(0, 20)))
        rows.append((i, text, blob, i / 7, i % 3 == 0, None if i % 5 == 0 else i * 10**9))
    rows.append((400, "\\N", b"\\N", 0.5, None, 1))
    schema = "id int, text string, blob binary, x double, flag boolean, big bigint"
    df = spark.createDataFrame(rows, schema).repartition(3)
    root = scratch(spark, "dump")
    export_table(df, root, "ns", "db", "t", moment("2024-01-31 03:00:00"), F.col("id") % 2)
    for range_bytes in (401, 1 << 20):
        back = read_dump(spark, root, df.schema, range_bytes).collect()
        assert sorted(map(tuple, back)) == sorted(map(tuple, df.collect()))


def test_export_is_filed_under_the_day_before(spark):
    root = scratch(spark, "dump")
    export_table(spark.range(3), root, "ns", "db", "t", moment("2024-03-01 01:00:00"))
    assert spark.read.text(root).select("dt").distinct().first()[0].isoformat() == "2024-02-29"


def test_line_numbers(spark):
    root = scratch(spark, "lines")
    text = [("\n".join(f"{i}-{'x' * (i % 50)}" for i in range(500)),)]
    spark.createDataFrame(text, "value string").write.text(root)
    rows = number_lines(read_lines(spark, root, range_bytes=2000)).collect()
    assert sorted(r.line_no for r in rows) == list(range(500))
    assert all(int(r.line.split("-")[0]) == r.line_no for r in rows)


def test_a_long_text_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    docs = [(i, f"{i} a\n{i} b", ("de", "en", "en")[i % 3]) for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(files, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    found = files.numbered_lines(spark, str(tmp_path)).collect()
    expected = []
    for lang in ("de", "en"):
        lines = [line for _, text, own in docs if own == lang for line in text.split("\n")]
        expected += [(lang, i, hashlib.md5(line.encode()).hexdigest()) for i, line in enumerate(lines)]
    assert sorted(map(tuple, found)) == sorted(expected)
    assert len(list(tmp_path.glob("lines/lang=en/*.txt"))) > 2


def test_unreadable_record_is_an_error(spark):
    root = scratch(spark, "dump")
    spark.createDataFrame([("only one field",)], "value string").write.text(root)
    schema = T.StructType().add("a", "string").add("b", "string")
    with pytest.raises(Exception):
        read_dump(spark, root, schema).collect()


def test_paths_as_spark_writes_them():
    for path in ("/tmp/a b", "file:/tmp/a b", "file:///tmp/a b"):
        assert _file_system(path)[1] == "/tmp/a b"


def test_dump_under_a_file_uri(spark, tmp_path):
    root = f"file:{tmp_path}/dump"
    df = spark.range(10).select("id", F.col("id").cast("string").alias("t"))
    export_table(df, root, "ns", "db", "t", moment("2024-01-31 03:00:00"))
    assert sorted(map(tuple, read_dump(spark, root, df.schema).collect())) == [(i, str(i)) for i in range(10)]


def test_truncated_last_record_is_read(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"1\ta\n2\tb")
    got = read_dump(spark, str(tmp_path), T.StructType().add("a", "integer").add("b", "string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b")]
