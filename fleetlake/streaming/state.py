"""Streams that keep a current-state table, and running a stream over what is there."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.lifecycle import active_locks, lifecycle_state
from ..operators.mining import mine_pairs
from ..session import scratch, shared_root
from ..sinks.upsert import KeyedTable


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there, in as many batches as the source asks for, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_to_path(stream: DataFrame, name: str) -> str:
    """The folder, shared by the cluster, that a stream's finished output is in."""
    path = scratch(stream.sparkSession, name)
    run_available(stream, path, scratch(stream.sparkSession, f"{name}-checkpoint"))
    return path


def collect_stream(stream: DataFrame, name: str) -> DataFrame:
    """The finished output of a stream, by way of the shared folder."""
    return stream.sparkSession.read.schema(stream.schema).parquet(stream_to_path(stream, name))


def into_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run ``handle(batch, number)`` over everything that is there."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def merge_batches(stream: DataFrame, table: KeyedTable, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Merge each batch of a stream into ``table``, under the stream's name and the batch's number."""
    writer = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    return into_batches(stream, lambda batch, number: table.merge(batch, number=number, writer=writer), checkpoint, mode)


class Arrivals(StreamingQueryListener):
    """Sums of an observed metric ``arrived`` over all batches of the queries that report it under ``name``.

    Progress is told batch by batch, so no batch is forgotten, however many there are; a batch told twice counts once.
    """

    def __init__(self, name: str) -> None:
        self.name, self.batches, self.ended, self.told = name, {}, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches[event.progress.batchId] = seen["arrived"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.told:
            self.ended.add(str(event.runId))
            self.told.notify_all()

    def wait_for(self, query: StreamingQuery, seconds: int = 60) -> None:
        """Until all of an ended query's progress is told."""
        with self.told:
            if not self.told.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError(f"the end of query {query.runId} was not told")


def keep_windows(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str = "arrivals") -> int:
    """Keep the newest state of every window, open ones too, in ``table``; returns the rows that arrived.

    ``stream`` counts per window and observes its arrivals under ``name`` (see ``late_metrics``), a name that only this
    query has at the time. What arrived and is in no window came too late.
    """
    arrivals = Arrivals(name)
    streams = stream.sparkSession.streams
    streams.addListener(arrivals)
    try:
        arrivals.wait_for(merge_batches(stream, table, checkpoint, "update"))
    finally:
        streams.removeListener(arrivals)
    return sum(arrivals.batches.values())


def keep_current(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Merge a stream of events into a table of the newest row per key.

    Each batch is reduced to one row per key before it is written; a batch that is
    repeated after a failure changes nothing.
    """
    merge_batches(stream, table, checkpoint)


def active_locks_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, as_of: Column) -> DataFrame:
    """Follow lock events and return the locks in force: newest rows that are neither released nor expired.

    ``table`` is keyed by lock and ordered by the time of its last change; a release is a row
    without ``lock_active``.
    """
    keep_current(stream, table, checkpoint)
    return active_locks(table.read(), as_of)


def lifecycle_stream(
    stream: DataFrame, table: KeyedTable, checkpoint: str, as_of: Column, activities: Sequence[str]
) -> DataFrame:
    """Follow retirement steps and return the state of each server in the queue.

    ``table`` has the newest row per (hostname, instance_id, activity).
    """
    keep_current(stream, table, checkpoint)
    return lifecycle_state(table.read(), as_of, activities)


def with_position(stream: DataFrame, position: str = "position") -> DataFrame:
    """``stream`` with a log position, ``name.number:offset``, as the numbers log_number and log_offset."""

    def number(group: int) -> Column:
        return F.regexp_extract(position, r"(\d+):(\d+)$", group).cast("bigint")

    return stream.withColumns({"log_number": number(1), "log_offset": number(2)})


def change_apply(
    stream: DataFrame, table: KeyedTable, position: str, ts: str, checkpoint: str, watermark: str = "1 hour", kind: str = "type"
) -> DataFrame:
    """Apply change events and return the rows there are.

    Repeats of a position are dropped, and of a key the newest position wins, by the numbers of log
    and offset. A delete stays in ``table`` as a mark, so that an older change that comes late does
    not bring the row back.
    """
    timed = with_position(stream, position).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    keep_current(timed.dropDuplicatesWithinWatermark([position]), table, checkpoint)
    return table.read().where(F.col(kind) != "delete").drop("log_number", "log_offset")


def resumable_mining(pairs: DataFrame, a: str, b: str, names: tuple[str, str], root: str | None = None) -> DataFrame:
    """Mine a stream of pairs; calling it again goes on where it stopped.

    Progress belongs to the pair of input names: their md5 names the checkpoint, so other inputs
    start anew. Each pair is mined exactly once, whatever fails in between.
    """
    spark: SparkSession = pairs.sparkSession
    identity = hashlib.md5("".join(names).encode()).hexdigest()
    base = f"{(root or shared_root(spark)).rstrip('/')}/mining-{identity}"
    mined = mine_pairs(pairs, a, b)
    run_available(mined, f"{base}/substrings", f"{base}/checkpoint")
    return spark.read.schema(mined.schema).parquet(f"{base}/substrings")
