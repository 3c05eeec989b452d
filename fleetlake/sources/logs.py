"""Tool output as rows.

Every parser takes a DataFrame of lines. Those that look at neighbouring lines also take the
columns naming the file and numbering its lines without gaps (see ``records.number_lines``); they
join the few lines concerned on the number, so that the others are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats written by the tools whose output is read here.
CHECKSUM_LINE = (
    r"^(\d+-\d+T\d+:\d+:\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+\.\d+)\s+(.+?)\.(.+)$"
)
CHECKSUM_FIELDS = {
    "ts": "string",
    "errors": "int",
    "diffs": "int",
    "rows": "bigint",
    "chunks": "int",
    "skipped": "int",
    "elapsed": "double",
    "db": "string",
    "tbl": "string",
}
ENGINE_STATUS = [
    (
        r"^OS WAIT ARRAY INFO: reservation count (\d+), signal count (\d+)",
        [("oswait_array.reservation_count", ""), ("oswait_array.signal_count", "")],
    ),
    (
        r"^Mutex spin waits (\d+), rounds (\d+), OS waits (\d+)",
        [("locks.spin_waits", "mutex"), ("locks.rounds", "mutex"), ("locks.os_waits", "mutex")],
    ),
    (
        r"^RW-shared spins (\d+), OS waits (\d+); RW-excl spins (\d+), OS waits (\d+)",
        [
            ("locks.spin_waits", "rw-shared"),
            ("locks.os_waits", "rw-shared"),
            ("locks.spin_waits", "rw-exclusive"),
            ("locks.os_waits", "rw-exclusive"),
        ],
    ),
    (
        r"^Ibuf: size (\d+), free list len (\d+), seg size (\d+), (\d+) merges",
        [("ibuf.size", ""), ("ibuf.free_list_len", ""), ("ibuf.seg_size", ""), ("ibuf.merges", "")],
    ),
    (
        r"^insert (\d+), delete mark (\d+), delete (\d+)",
        [("ibuf.inserts", ""), ("ibuf.delete_mark", ""), ("ibuf.delete", "")],
    ),
    (r"^\d+ queries inside InnoDB, (\d+) queries in queue", [("queries_queued", "")]),
    (r"^(\d+) read views open inside InnoDB", [("opened_read_views", "")]),
    (r"^History list length (\d+)", [("history_list_length", "")]),
]
MERGED_OPERATIONS = "merged operations:"
BINLOG_STAMP = "yyMMdd H:mm:ss"
POSITION_FILE = r"MASTER_LOG_FILE='([a-z0-9-.]+)'"
POSITION_OFFSET = r"MASTER_LOG_POS=([0-9]+)"
POSITION_GTID = r"gtid_purged='([a-z0-9-:,\s]+)';"
SERVER_EVENTS = [
    ("ready for connections", "STARTED"),
    ("mysqld: Shutdown complete", "STOPPED"),
    ("A mysqld process already exists", "ERROR"),
]
BACKUP_OK = "completed OK!"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that matches the whole text, by one pass of it."""
    mark = "\x01"
    return F.split(F.regexp_replace(text, pattern, mark.join(f"${i}" for i in range(1, n + 1))), mark, n)


def parse_checksum_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Result lines of a table checksum run; other lines are dropped."""
    kept = [c for c in lines.columns if c != line]
    results = lines.where(F.col(line).rlike(CHECKSUM_LINE))
    found = results.select(*kept, _groups(F.col(line), CHECKSUM_LINE, len(CHECKSUM_FIELDS)).alias("__g"))
    fields = [F.col("__g")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(CHECKSUM_FIELDS.items())]
    return found.select(*kept, *fields)


def sync_diffs(line: Column) -> Column:
    """Differences counted by one line of a table sync run; 0 for any line that is not a count."""
    fields = F.split(F.btrim(line, F.lit(" \t\r\n\f\v")), r"\s+")
    counts = [F.try_element_at(fields, F.lit(i)).try_cast("bigint") for i in range(2, 6)]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    is_count = (F.size(fields) == 10) & (fields[0] == "#")
    return F.when(is_count, F.coalesce(total, F.lit(0))).otherwise(F.lit(0))


def parse_sync_log(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Sum of all differences per run."""
    return lines.groupBy(*keys).agg(F.sum(sync_diffs(F.col(line))).cast("long").alias("diff_count"))


def parse_engine_status(lines: DataFrame, file: str = "path", order: str = "line_no", line: str = "line") -> DataFrame:
    """Storage engine counters as (file, order, metric, type, value).

    The first family that matches a line gives its metrics. The insert-buffer family counts
    only on the line after the ``merged operations:`` header.
    """
    text = F.col(line)
    inserts = [f for f in ENGINE_STATUS if f[1][0][0] == "ibuf.inserts"]
    others = [f for f in ENGINE_STATUS if f not in inserts]
    headers = lines.where(text.startswith(MERGED_OPERATIONS)).select(file, (F.col(order) + 1).alias(order))
    after_header = lines.where(text.rlike(inserts[0][0])).join(headers, [file, order], "left_semi")
    return _engine_metrics(lines, others, file, order, text).unionByName(
        _engine_metrics(after_header, inserts, file, order, text)
    )


def _engine_metrics(lines: DataFrame, families, file: str, order: str, text: Column) -> DataFrame:
    metrics = None
    for pattern, outputs in families:
        values = F.array(
            *[
                F.struct(
                    F.lit(f"innodb.{name}").alias("metric"),
                    F.lit(kind).alias("type"),
                    F.regexp_extract(text, pattern, i).cast("long").alias("value"),
                )
                for i, (name, kind) in enumerate(outputs, 1)
            ]
        )
        hit = text.rlike(pattern)
        metrics = F.when(hit, values) if metrics is None else metrics.when(hit, values)
    rows = lines.select(file, order, F.explode(metrics).alias("m"))
    return rows.select(file, order, "m.metric", "m.type", "m.value")


def binlog_starts(lines: DataFrame, file: str = "path", order: str = "line_no", line: str = "line") -> DataFrame:
    """(file, started): the first ``created`` stamp of each log."""
    # Hours are padded with a blank, and words may follow the stamp.
    stamp = _found(F.col(line), r"created (\d{6} +\d{1,2}:\d{2}:\d{2})")
    text = F.regexp_replace(stamp, " +", " ")
    stamps = lines.where(F.col(line).contains("created")).select(
        file, order, F.try_to_timestamp(text, F.lit(BINLOG_STAMP)).cast("timestamp_ntz").alias("ts")
    )
    return stamps.groupBy(file).agg(F.min_by("ts", order).alias("started"))


def binlog_gtids(lines: DataFrame, file: str = "path", order: str = "line_no", line: str = "line") -> DataFrame:
    """(file, order, ts, gtid): a commit line's stamp and the id on the line after it."""
    text = F.col(line)
    stamp = _found(text, r"^#(\d{6} +\d+:\d{2}:\d{2})")
    ts = F.try_to_timestamp(F.regexp_replace(stamp, " +", " "), F.lit(BINLOG_STAMP)).cast("timestamp_ntz")
    commits = lines.where(text.rlike(r"GTID.*commit")).select(file, order, ts.alias("ts"))
    gtid = F.try_element_at(F.split(text, "'"), F.lit(2))
    named = lines.where(text.contains("GTID_NEXT")).select(file, (F.col(order) - 1).alias(order), gtid.alias("gtid"))
    return commits.join(named, [file, order])


def parse_slave_position(text: Column) -> Column:
    """Position from CHANGE MASTER text; a list of transaction ids wins over file and offset."""
    gtid = _found(text, POSITION_GTID)
    return F.struct(
        F.when(gtid.isNull(), _found(text, POSITION_FILE)).alias("log"),
        F.when(gtid.isNull(), _found(text, POSITION_OFFSET).cast("long")).alias("pos"),
        gtid.alias("gtid"),
        (gtid.isNull() & _found(text, POSITION_FILE).isNull()).alias("bad"),
    )


def parse_binlog_position(text: Column) -> Column:
    """Position from tab-separated text of 2 fields, or 4 when there are transaction ids."""
    fields = F.split(F.trim(text), "\t")
    valid = F.size(fields).isin(2, 4)
    pos = F.trim(F.try_element_at(fields, F.lit(2))).try_cast("long")
    gtid = F.trim(F.replace(F.try_element_at(fields, F.lit(4)), F.lit("\n"), F.lit(" ")))
    return F.struct(
        F.when(valid, F.trim(fields[0])).alias("log"),
        F.when(valid, pos).alias("pos"),
        F.when(valid, gtid).alias("gtid"),
        (~valid | pos.isNull()).alias("bad"),
    )


def parse_backup_position(text: Column) -> Column:
    """Replication position in any of the three shapes; ``bad`` marks text in none of them."""
    change_master = text.contains("MASTER_LOG_FILE") | text.contains("gtid_purged")
    return F.when(change_master, parse_slave_position(text)).otherwise(parse_binlog_position(text))


def server_state_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of an error log that start or stop the server, with ``state``."""
    state = None
    for marker, name in SERVER_EVENTS:
        hit = F.col(line).contains(marker)
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return lines.withColumn("state", state).where("state IS NOT NULL")


def first_server_state(
    lines: DataFrame, start: Column, file: str = "path", order: str = "line_no", line: str = "line"
) -> DataFrame:
    """The state that decides per log: the first event at or after ``start``."""
    events = server_state_events(lines, line).where(F.col(order) >= start)
    return events.groupBy(file).agg(F.min_by("state", order).alias("state"))


def log_verdict(
    lines: DataFrame, marker: str = BACKUP_OK, file: str = "path", order: str = "line_no", line: str = "line"
) -> DataFrame:
    """(file, ok): a job log is good only if its last line holds the marker."""
    last = lines.groupBy(file).agg(F.max_by(line, order).alias("last_line"))
    return last.select(file, F.col("last_line").contains(marker).alias("ok"))
