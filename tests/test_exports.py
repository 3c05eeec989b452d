"""Commit and abort of exports, pruning by pushed filters, servers that fail, bounds from footers."""

from __future__ import annotations

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlake.plans.export import checked_export
from fleetlake.queries.exports import ORDER, fetch_share
from fleetlake.sinks import checked as C
from fleetlake.sources import fleet as S
from fleetlake.sources import statistics as P

def rows(spark, n=1000):
    text = F.concat(F.lit("a\tb\\c\n"), F.col("id"))
    return spark.range(0, n, 1, 4).select("id", text.alias("text"), F.concat(F.lit("t/ä "), F.col("id") % 3).alias("kind"))


def write(df, root, name="e", **more):
    fixed = {c: F.lit(v) for c, v in {"namespace": "n", "db": "d", "dt": "2024-01-30", "part": 0}.items()}
    C.write_export(df, str(root), name, {**fixed, "table": F.col("kind")}, **more)


def back(spark, root, name="e", **more):
    return C.read_export(spark, str(root), name, **more).select("id", "text", "kind")


def data_files(root):
    return {os.path.join(at, f) for at, _, files in os.walk(root) for f in files if ".txt" in f}


@pytest.mark.parametrize("compression", ["none", "gzip", "zstd"])
def test_round_trip_in_ranges(spark, tmp_path, compression):
    write(rows(spark), tmp_path, compression=compression, position="{}")
    got = back(spark, tmp_path, range_bytes=700)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows(spark).collect()))
    head, files = C.read_manifest(str(tmp_path), "e")
    assert head["rows"] == 1000 == sum(f["rows"] for f in files) and head["position"] == "{}"
    assert {f["table"] for f in files} == {"t/ä 0", "t/ä 1", "t/ä 2"}


def test_failed_run_is_never_seen_and_swept(spark, tmp_path):
    bad = rows(spark).withColumn("text", F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        write(bad, tmp_path)
    with pytest.raises(FileNotFoundError):
        back(spark, tmp_path)
    # Over an export that stands: it stays as it is.
    write(rows(spark), tmp_path)
    listed = {str(tmp_path / f["file"]) for f in C.read_manifest(str(tmp_path), "e")[1]}
    with pytest.raises(Exception):
        write(bad, tmp_path)
    assert back(spark, tmp_path).count() == 1000
    # Tasks that were running at the abort may leave files: young ones stay, as a run may be going.
    time.sleep(3)
    now = datetime.datetime.now(datetime.timezone.utc)
    C.sweep(spark, str(tmp_path), now - datetime.timedelta(hours=1))
    assert listed <= data_files(tmp_path)
    C.sweep(spark, str(tmp_path), now)
    assert data_files(tmp_path) == listed and back(spark, tmp_path).count() == 1000


def test_sweep_of_an_orphan(spark, tmp_path):
    assert C.sweep(spark, str(tmp_path), datetime.datetime.now(datetime.timezone.utc)) == []
    os.makedirs(tmp_path / ".run-x" / "a")
    now = datetime.datetime.now(datetime.timezone.utc)
    assert C.sweep(spark, str(tmp_path), now - datetime.timedelta(hours=1)) == []
    assert C.sweep(spark, str(tmp_path), now + datetime.timedelta(seconds=1)) == [".run-x"]


def test_run_again_replaces_only_its_name(spark, tmp_path):
    write(rows(spark), tmp_path)
    write(rows(spark, 50), tmp_path, "e.2")
    write(rows(spark, 10), tmp_path)
    assert back(spark, tmp_path).count() == 10 and back(spark, tmp_path, "e.2").count() == 50
    lines = C.export_commits(spark, str(tmp_path)).where("file IS NULL").select("name", "version", "rows")
    assert sorted(map(tuple, lines.collect())) == [("e", 2, 10), ("e.2", 1, 50)]
    listed = {f["file"] for n in ("e", "e.2") for f in C.read_manifest(str(tmp_path), n)[1]}
    assert {os.path.relpath(f, tmp_path) for f in data_files(tmp_path)} == listed


def test_files_that_no_task_named_are_not_read(spark, tmp_path):
    write(rows(spark), tmp_path)
    some = sorted(data_files(tmp_path))[0]
    with open(some, "rb") as one, open(os.path.join(os.path.dirname(some), "late.txt"), "wb") as late:
        late.write(one.read())
    assert back(spark, tmp_path).count() == 1000


def test_commit_refuses_changed_files(spark, tmp_path):
    options = {"path": str(tmp_path), "name": "e", "run": "r", "rowschema": "{}"}
    writer = C.ExportWriter(options)
    entry, out = writer._open({"namespace": "n", "db": "d", "table": "t", "dt": "x", "part": "0"})
    out.write(b"1\n")
    out.close()
    # An attempt that failed (None) and one whose file was cut.
    with pytest.raises(ValueError):
        writer.commit([None, C.Written([{**entry, "rows": 1, "bytes": 5}])])
    writer.abort([])
    assert not data_files(tmp_path)
    with pytest.raises(FileNotFoundError):
        C.read_manifest(str(tmp_path), "e")


def test_empty_and_null_tables(spark, tmp_path):
    write(rows(spark).where("id < 0"), tmp_path)
    assert back(spark, tmp_path).count() == 0
    write(rows(spark, 3).withColumn("kind", F.lit(None).cast("string")), tmp_path)
    got = C.read_export(spark, str(tmp_path), "e").select("table", "kind").distinct().collect()
    assert [tuple(r) for r in got] == [(C.NO_VALUE, None)]


def test_no_position_no_export(spark, tmp_path):
    status = spark.createDataFrame([], "heartbeat timestamp, log string, pos bigint, gtids string")
    with pytest.raises(ValueError):
        checked_export(rows(spark), str(tmp_path), "e", "h-1", "d", "kind", {}, F.lit("2024-01-31").cast("timestamp"), status)
    assert not data_files(tmp_path)


def test_only_wanted_files_are_opened(spark, tmp_path):
    write(rows(spark), tmp_path)
    for only, left in [({"table": ["t/ä 1"]}, {1}), ({"table": ["t/ä 0", "t/ä 2"], "part": [0]}, {0, 2}), ({"dt": []}, set())]:
        got = {r["id"] for r in C.read_export(spark, str(tmp_path), "e", ["id"], only).collect()}
        assert got == {i for i in range(1000) if i % 3 in left}
    for entry in C.read_manifest(str(tmp_path), "e")[1]:
        if entry["table"] != "t/ä 1":
            os.remove(tmp_path / entry["file"])
    assert C.read_export(spark, str(tmp_path), "e", ["id"], {"table": ["t/ä 1"]}).count() == 333
    with pytest.raises(Exception):
        C.read_export(spark, str(tmp_path), "e", ["id"]).count()
    with pytest.raises(ValueError):
        C.read_export(spark, str(tmp_path), "e", only={"id": ["1"]})


def test_filters_of_one_query_do_not_reach_the_next(spark, tmp_path):
    write(rows(spark), tmp_path)
    read = C.read_export(spark, str(tmp_path), "e", ["id"])
    assert read.where("`table` = 't/ä 1'").count() == 333 and read.count() == 1000
    both = read.where("`table` = 't/ä 1'").union(read.where("`table` = 't/ä 2'")).groupBy("table").count()
    assert sorted(map(tuple, both.collect())) == [("t/ä 1", 333), ("t/ä 2", 333)]


def test_servers_fail_alone_and_halfway(spark):
    def fetch(instance, options):
        import pyarrow as pa

        n = int(options["n"])
        yield pa.RecordBatch.from_pydict({"more": ["x"] * n, "o_custkey": list(range(n)), "o_orderkey": [7] * n})
        if n == 3:
            raise OSError("gone")

    servers = spark.createDataFrame([(f"s{n}", {"n": str(n)}) for n in range(5)] + [("none", None)], "instance string, options map<string,string>")
    got = S.read_servers(servers, fetch, ORDER, 3)
    counts = {r["instance"]: (r["n"], r["e"]) for r in got.groupBy("instance").agg(F.count("o_orderkey").alias("n"), F.max("error").alias("e")).collect()}
    assert counts == {
        "s1": (1, None), "s2": (2, None), "s3": (3, "OSError: gone"), "s4": (4, None), "none": (0, "KeyError: 'n'"),
    }
    assert {r["instance"] for r in S.whole_servers(got).collect()} == {"s1", "s2", "s4"}
    with pytest.raises(ValueError):
        S.read_servers(servers, fetch, T.StructType([T.StructField("error", T.StringType())]), 1)


def test_a_server_is_read_a_batch_at_a_time(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, path = 2_000_000, str(tmp_path / "orders.parquet")
    table = pa.table({"o_orderkey": pa.array(range(n)), "o_custkey": pa.array(range(n))})
    pq.write_table(table, path, row_group_size=n, compression="none", use_dictionary=False)
    del table
    before, most, keys = pa.total_allocated_bytes(), 0, []
    for batch in fetch_share("db-5", {"path": path, "number": "5", "of": "12"}):
        most = max(most, pa.total_allocated_bytes() - before)
        keys += batch.column("o_orderkey").to_pylist()
    assert keys == list(range(5, n, 12))
    assert most < 8_000_000  # the row group is 32 MB


def test_five_thousand_servers_are_one_plan(spark):
    servers = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("instance"), F.create_map(F.lit("n"), F.lit("1")).alias("options"))
    began = time.monotonic()
    plan = S.read_servers(servers, lambda i, o: iter(()), ORDER, 500)._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - began < 10 and plan.count("Range") == 1


def test_bounds_hold_for_any_range(spark, tmp_path):
    value = F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(1000)) + F.col("id"))
    table = spark.range(20000).select(value.alias("v"), F.lit(None).cast("long").alias("none"), F.concat(F.lit("s"), "id").alias("s"))
    table.repartitionByRange(8, "v").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    groups = P.footers(spark, str(tmp_path / "t"), ["v", "none", "s", "absent"], tasks=3)
    total = P.table_rows(groups).collect()[0]
    assert (total["rows"], total["files"]) == (20000, 8)
    for low, high in [(-5, -1), (0, 500), (3000, 9000), (700, 700), (0, 30000), (21000, 40000)]:
        got = {r["column"]: r for r in P.rows_between(groups, low, high).collect()}
        true = table.where(F.col("v").between(low, high)).count()
        v = got["v"]
        assert v["at_least"] <= true <= v["at_most"] and v["at_least"] <= v["estimate"] <= v["at_most"]
        assert got["none"]["at_most"] == 0 and (got["absent"]["at_least"], got["absent"]["at_most"]) == (0, 20000)
        assert got["s"]["at_least"] == 0
    assert P.rows_between(groups.where("`column` = 'v'"), 0, 30000).collect()[0]["at_least"] == table.where("v IS NOT NULL").count()
    ranges = {r["column"]: r for r in P.column_ranges(groups).collect()}
    low, high, nulls = table.agg(F.min("v"), F.max("v"), F.count_if(F.col("v").isNull())).collect()[0]
    assert (ranges["v"]["low"], ranges["v"]["high"], ranges["v"]["nulls"]) == (low, high, nulls)
    assert ranges["absent"]["nulls"] is None and ranges["s"]["low"] is None and ranges["none"]["nulls"] == 20000


def test_footers_do_not_depend_on_data_pages(spark, tmp_path):
    spark.range(100000).write.parquet(str(tmp_path / "t"))
    size = next(p for p in sorted((tmp_path / "t").iterdir()) if p.name.startswith("part-"))
    with open(size, "r+b") as file:
        file.seek(4)
        file.write(b"\xff" * 2000)
    assert P.table_rows(P.footers(spark, str(tmp_path / "t"))).collect()[0]["rows"] == 100000


def test_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t"))
    groups = P.footers(spark, str(tmp_path / "t"), ["id"])
    assert P.table_rows(groups).collect()[0]["rows"] == 0 and P.rows_between(groups, 0, 1).count() == 0
