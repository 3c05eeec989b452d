"""Known cases of single operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlake.functions import hosts as H
from fleetlake.functions import moments as M
from fleetlake.operators import filters as P
from fleetlake.operators import lag as G
from fleetlake.operators import latest as N
from fleetlake.operators import lifecycle as Y
from fleetlake.operators import planning as Q
from fleetlake.operators.consistency import checksum_status, reported_status
from fleetlake.operators.percentiles import histogram_percentile
from fleetlake.plans.metrics import as_metrics
from fleetlake.session import scratch
from fleetlake.sinks.files import atomic_write
from fleetlake.sinks.upsert import KeyedTable
from fleetlake.sources import logs as S
from fleetlake.sources import topology as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_host_names(spark):
    row = one(spark, H.host_parts(F.lit("sharddb-12-3:3309")).alias("a"), H.host_parts(F.lit("sharddb-1-1")).alias("b"))
    assert (row.a.prefix, row.a.set_num, row.a.host_id, row.a.port) == ("sharddb", "12", "3", 3309)
    assert row.b.port == 3306 and row.b.valid
    path = "xtrabackup/standard/testdb-1/testdb-1-79-3306-2016-05-18-22:34:39.xbstream"
    got = one(spark, H.backup_file_parts(F.lit(path)).alias("f")).f
    assert (got.host, got.port, got.created) == ("testdb-1-79", 3306, dt.date(2016, 5, 18))
    files = one(spark, H.table_file_parts(F.lit("users.ibd")).alias("a"), H.table_file_parts(F.lit("users#P#p3.ibd")).alias("b"))
    assert tuple(files.a) == ("users", "") and tuple(files.b) == ("users", "p3")


def test_grant(spark):
    text = "GRANT SELECT, INSERT ON *.* TO 'app'@'10.%' IDENTIFIED BY PASSWORD '*AB' WITH GRANT OPTION"
    got = one(spark, H.parse_grant(F.lit(text)).alias("g")).g
    assert tuple(got) == ("SELECT, INSERT", "app", "10.%", "*AB", True)


def test_checksum_line(spark):
    line = "08-30T06:25:33      0      0    28598      60       0   0.547 shard04159.userstats"
    df = spark.createDataFrame([(line,), ("TS ERRORS DIFFS",)], "line string")
    assert tuple(S.parse_checksum_log(df).first()) == ("08-30T06:25:33", 0, 0, 28598, 60, 0, 0.547, "shard04159", "userstats")
    assert S.parse_checksum_log(df).count() == 1


def test_sync_line(spark):
    lines = [("#  1 2 0 2 Chunk 00 00 2 db.t",), ("# 1 x 0 2 Chunk 00 00 2 db.t",), ("# DELETE REPLACE",), ("REPLACE INTO t",)]
    df = spark.createDataFrame(lines, "line string")
    assert [r[0] for r in df.select(S.sync_diffs(F.col("line"))).collect()] == [5, 0, 0, 0]


def test_positions(spark):
    texts = [
        "CHANGE MASTER TO MASTER_LOG_FILE='mysql-bin.006233', MASTER_LOG_POS=863",
        "SET GLOBAL gtid_purged='b27a8edf-eca1-11e6-99e4-0e695f0e3b16:1-3862';\nCHANGE MASTER TO MASTER_AUTO_POSITION=1",
        "mysql-bin.006231\t1619",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(S.parse_backup_position(F.col("t"))).collect()]
    assert got == [
        ("mysql-bin.006233", 863, None, False),
        (None, None, "b27a8edf-eca1-11e6-99e4-0e695f0e3b16:1-3862", False),
        ("mysql-bin.006231", 1619, None, False),
    ]


def test_bytes_behind(spark):
    logs = spark.createDataFrame([("m", 289, 104858825), ("m", 290, 104857726), ("m", 291, 47024156)], "master string, log_num long, size long")
    status = spark.createDataFrame([("r", "m", 290, 98926487, None, None)], "instance string, master string, l long, p long, l2 long, p2 long")
    got = G.bytes_behind(status, logs, {"sql": ("l", "p"), "io": ("l2", "p2")}).first()
    assert (got.sql_bytes, got.sql_binlogs) == (52955395, 1)
    # No position yet: everything, whole.
    assert (got.io_bytes, got.io_binlogs) == (104858825 + 104857726 + 47024156, 3)


def test_log_number(spark):
    assert one(spark, G.log_number(F.lit("mysql-bin.000291")))[0] == 291


def test_percentile_skips_empty_buckets(spark):
    h = spark.createDataFrame([("h", 1, 0, 0.0), ("h", 2, 9, 0.9), ("h", 3, 1, 5.0), ("e", 1, 0, 0.0)], "k string, bucket int, count long, total double")
    got = {(r.k, r.percentile): round(r.value, 6) for r in histogram_percentile(h, ["k"], (50, 90, 99)).collect()}
    assert got == {("h", 50.0): 100.0, ("h", 90.0): 100.0, ("h", 99.0): 5000.0}


@pytest.mark.parametrize(
    "errors, diffs, skips, wanted",
    [
        (1, 0, 0, "ERRORS_IN_CHECKSUM_PROCESS"),
        (0, 0, 0, "GOOD"),
        (0, 6, 0, "TOO_MANY_CHUNK_DIFFS"),
        (0, 3, 3, "TOO_MANY_CHUNK_DIFFS"),
        (0, 2, 3, "ROW_DIFFS_FOUND"),
        (0, 0, 3, "CHUNKS_WERE_SKIPPED"),
    ],
)
def test_checksum_status(spark, errors, diffs, skips, wanted):
    assert one(spark, checksum_status(F.lit(errors), F.lit(diffs), F.lit(skips)))[0] == wanted


def test_status_options(spark):
    few = checksum_status(F.lit(0), F.lit(1), F.lit(0), min_diffs=2)
    cleared = reported_status(F.lit("ROW_DIFFS_FOUND"), F.lit("YES"), F.lit(0))
    assert tuple(one(spark, few, cleared)) == ("CHUNK_DIFFS_FOUND_BUT_OK", "GOOD")


def test_replica_config_documents(spark):
    base = '{"rs1": {"db": "d", "user": "u", "passwd": "p", "master": {"host": "a-1-1", "port": 3306}, "slave": {"host": "a-1-2", "port": 3306}}}'
    dr = '{"rs1": {"dr_slave": {"host": "a-1-9", "port": 3307}}}'
    docs = [spark.createDataFrame([(x,)], "doc string") for x in (base, dr)]
    got = sorted(tuple(r) for r in T.read_replica_config(docs[:1], docs[1]).collect())
    assert got == [("rs1", "dr_slave", "a-1-9", 3307, "d"), ("rs1", "master", "a-1-1", 3306, "d"), ("rs1", "slave", "a-1-2", 3306, "d")]


def test_inventory_gate(spark):
    with pytest.raises(Exception, match="too few"):
        P.min_rows_gate(spark.range(99)).collect()
    with pytest.raises(Exception, match="too few"):
        P.min_rows_gate(spark.range(0)).collect()
    assert P.min_rows_gate(spark.range(100)).count() == 100


def test_next_free_name(spark):
    inventory = spark.createDataFrame([("rs", 3), ("rs", 1), ("new", 0)], "replica_set string, host_id long")
    used = spark.createDataFrame([("rs", 2), ("rs", 4), ("rs", 5), ("rs", 7)], "replica_set string, host_id long")
    got = {r.replica_set: r.hostname for r in Q.next_free_name(inventory, used).collect()}
    assert got == {"rs": "rs-6", "new": "new-1"}


@pytest.mark.parametrize("old, sets, wanted", [(20, 100, 11), (3, 100, 3), (0, 700, 11), (0, 130, 2), (1, 130, 2)])
def test_restore_plan(spark, old, sets, wanted):
    rows = [(f"rs{i:04d}", 80 if i < old else 10) for i in range(sets)]
    plan = Q.plan_restore_tests(spark.createDataFrame(rows, "replica_set string, age int")).collect()
    ordered = sorted(plan, key=lambda p: p.launch_order)
    assert [p.replica_set for p in ordered] == [r[0] for r in rows]
    assert [p.start_now for p in ordered] == [True] * wanted + [False] * (sets - wanted)


def test_gates(spark):
    now = "2024-05-02 {}:00"
    for clock, running, day, wanted in [
        ("00:10", False, "2024-05-01", "too_early"),
        ("01:00", True, "2024-05-01", "running"),
        ("01:00", False, "2024-05-01", "check"),
        ("02:30", True, "2024-05-01", "check"),
        ("00:10", True, "2024-04-30", "check"),
    ]:
        gate = M.export_gate(F.lit(day).cast("date"), M.moment(now.format(clock)), F.lit(running))
        assert one(spark, gate)[0] == wanted


def test_lifecycle_boundary(spark):
    log = [("h1", "i1", Y.RESET_STATS, dt.datetime(2024, 1, 9, 6)), ("h2", "i2", Y.RESET_STATS, dt.datetime(2024, 1, 9, 6, 0, 1))]
    df = spark.createDataFrame(log, "hostname string, instance_id string, activity string, happened timestamp_ntz")
    got = {r.hostname: r.state for r in Y.lifecycle_state(df, M.moment("2024-01-10 00:00:00")).collect()}
    assert got == {"h1": "READY_FOR_MYSQL_SHUTDOWN", "h2": "ADDED"}


def test_upsert_modes(spark):
    target = spark.createDataFrame([(1, 5, "t")], "k int, seq int, v string")
    changes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")], "k int, seq int, v string")
    replaced = sorted((r.k, r.v) for r in N.upsert(target, changes, ["k"], ["seq"]).collect())
    ignored = sorted((r.k, r.v) for r in N.upsert(target, changes, ["k"], ["seq"], "ignore").collect())
    assert replaced == [(1, "b"), (2, "d")] and ignored == [(1, "t"), (2, "c")]


def test_keyed_table_is_repeatable(spark):
    table = KeyedTable(spark, scratch(spark, "t"), ["k"], ["seq"])
    first = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "k int, seq int")
    second = spark.createDataFrame([(1, 2), (4, 1)], "k int, seq int")
    for batch in (first, second, first, second):
        table.merge(batch)
    assert sorted(map(tuple, table.read().collect())) == [(1, 2), (2, 1), (3, 1), (4, 1)]


def test_failed_check_writes_nothing(spark):
    path = scratch(spark, "atomic")
    with pytest.raises(ValueError):
        atomic_write(spark.range(3), path, lambda df: df.where("id = 1"))
    with pytest.raises(Exception):
        spark.read.parquet(path).collect()


def test_one_row_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).repartition(4).select((F.col("id") % 3).alias("k"), F.col("id").alias("ts"))
    plan = N.first_per_key(df, ["k"], [F.col("ts").desc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4)], "k string, ts int, id int")
    assert sorted(r.id for r in N.latest_per_key(df, ["k"], "ts").collect()) == [2, 3, 4]


def test_optional_tags(spark):
    rows = spark.createDataFrame([("h", 1, "a", "", 1), ("h", 1, None, "x", 2), ("h", 1, "", None, 3)], "host string, port int, kept string, kind string, v int")
    made = as_metrics(rows, F.lit("m"), F.col("v"), ["kept"], optional=["kind"]).collect()
    assert {int(r["value"]): r["tags"] for r in made} == {1: {"kept": "a"}, 2: {"kept": None, "kind": "x"}, 3: {"kept": ""}}
