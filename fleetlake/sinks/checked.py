"""Exports that end with data, position and marker, or with nothing at all.

Tasks write dump files into a hidden folder of the run. The commit is one small file, the run's manifest,
which gets its name last: a line with position, schema and totals, then a line per file that a successful
task named. Readers go by manifests, so files of failed or doubled attempts, of aborted runs and of a run
that is still going are never seen, wherever they lie. Nothing is moved but the manifest.

Defined cases: an export without rows commits a manifest without files. A run of the same name replaces
the earlier one, whose files are deleted after the new manifest stands; a reader that is just reading them
has to start again. A null in a layout column is filed under ``NO_VALUE``. Files whose size is not what
their task wrote make the commit fail, which aborts the run. An abort deletes the run's folder; a task that is
still running then, or a driver that dies, may leave files, which no reader sees and ``sweep`` deletes.
"""

from __future__ import annotations

import datetime
import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dump_line, typed_field
from ..session import qualified
from ..sources.records import RANGE_BYTES, ByteRange, _file_system, range_records, read_records, split_columns
from .export import LAYOUT

FORMAT = "fleet_export"
COMMITS = "_commits"
NO_VALUE = "__none__"
# Rows that a task puts together before it writes them.
_ROWS = 256
_SUFFIX = {"none": ".txt", "gzip": ".txt.gz", "zstd": ".txt.zst"}
_MANIFEST = (
    "name string, version int, position string, schema string, folder string, files bigint, file string, "
    + "".join(f"{c} string, " for c in LAYOUT) + "rows bigint, bytes bigint"
)


def _manifests(root: str, name: str):
    """(version, path) of a name's manifests, newest first."""
    from pyarrow import fs

    system, folder = _file_system(f"{root}/{COMMITS}")
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    start = quote(name, safe="") + "."
    ours = [f.path for f in found if f.base_name.startswith(start) and f.base_name.endswith(".json")]
    numbered = [(p.rsplit(".", 2)[1], p) for p in ours if p.rsplit("/", 1)[1].count(".") == start.count(".") + 1]
    return system, folder, sorted(((int(n), p) for n, p in numbered if n.isdigit()), reverse=True)


def read_manifest(root: str, name: str) -> tuple[dict, list[dict]]:
    """Head and files of the export that stands under ``name``; FileNotFoundError if none does."""
    system, _, found = _manifests(root, name)
    if not found:
        raise FileNotFoundError(f"no export {name} is committed in {root}")
    with system.open_input_stream(found[0][1]) as lines:
        head, *files = map(json.loads, lines.read().decode().splitlines())
    return head, files


class Written(D.WriterCommitMessage):
    """Files that one task wrote."""

    def __init__(self, files: list[dict]):
        self.files = files


class ExportWriter(D.DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.name, self.run = options["path"].rstrip("/"), options["name"], options["run"]
        self.compression = options.get("compression", "none")
        self.head = {"position": options.get("position"), "schema": options["rowschema"]}
        self.folder = f".run-{self.run}"

    def _open(self, place: dict):
        from pyarrow import fs

        below = "/".join(f"{c}={quote(place[c], safe='')}" for c in LAYOUT)
        file = f"{self.folder}/{below}/{uuid.uuid4().hex}{_SUFFIX[self.compression]}"
        system, path = _file_system(f"{self.root}/{file}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        codec = None if self.compression == "none" else self.compression
        return {"file": file, **place, "rows": 0}, system.open_output_stream(path, compression=codec)

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        files, current, out = [], None, None
        try:
            for batch in iterator:
                # Rows come sorted by their place, so one file is open at a time.
                parts = [pc.cast(batch.column(batch.schema.get_field_index(c)), pa.string()) for c in LAYOUT]
                runs = pc.run_end_encode(pc.binary_join_element_wise(*parts, "\0"))
                values, low = batch.column(batch.schema.get_field_index("value")), 0
                for key, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if key != current:
                        if out is not None:
                            out.close()
                        entry, out = self._open(dict(zip(LAYOUT, key.split("\0"))))
                        files.append(entry)
                        current = key
                    for at in range(low, high, _ROWS):
                        lines = values.slice(at, min(_ROWS, high - at)).to_pylist()
                        out.write("".join(line + "\n" for line in lines).encode())
                    files[-1]["rows"] += high - low
                    low = high
        finally:
            if out is not None:
                out.close()
        for entry in files:
            system, path = _file_system(f"{self.root}/{entry['file']}")
            entry["bytes"] = system.get_file_info(path).size
        return Written(files)

    def commit(self, messages):
        files = [entry for message in messages if message is not None for entry in message.files]
        for entry in files:
            system, path = _file_system(f"{self.root}/{entry['file']}")
            if system.get_file_info(path).size != entry["bytes"]:
                raise ValueError(f"{entry['file']} is not as its task wrote it")
        system, folder, earlier = _manifests(self.root, self.name)
        version = earlier[0][0] + 1 if earlier else 1
        same = {"name": self.name, "version": version}
        totals = {"files": len(files), "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files)}
        lines = [{**same, **self.head, "folder": self.folder, **totals}, *({**same, **f} for f in files)]
        system.create_dir(folder, recursive=True)
        staged = f"{folder}/.{self.run}"
        with system.open_output_stream(staged) as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        system.move(staged, f"{folder}/{quote(self.name, safe='')}.{version:08d}.json")
        for _, path in earlier:
            with system.open_input_stream(path) as old:
                head = json.loads(old.read().decode().split("\n", 1)[0])
            system.delete_file(path)
            self._drop(head["folder"])

    def abort(self, messages):
        self._drop(self.folder)

    def _drop(self, folder: str):
        from pyarrow import fs

        system, path = _file_system(f"{self.root}/{folder}")
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


class ExportRange(ByteRange):
    """A byte range of a file, with the place that the file belongs to."""

    def __init__(self, path, start, stop, place):
        super().__init__(path, start, stop)
        self.place = place


class ExportReader(D.DataSourceReader):
    def __init__(self, options):
        self.root, self.name = options["path"].rstrip("/"), options["name"]
        self.keep = [int(i) for i in options["keep"].split(",") if i]
        self.range_bytes = int(options["rangebytes"])
        self.only = json.loads(options["only"])

    def partitions(self):
        ranges = []
        for entry in read_manifest(self.root, self.name)[1]:
            if any(entry[c] not in values for c, values in self.only.items()):
                continue
            place = [entry[c] for c in LAYOUT]
            path, size = f"{self.root}/{entry['file']}", entry["bytes"]
            if not path.endswith(".txt"):
                ranges.append(ExportRange(path, 0, None, place))
                continue
            for start in range(0, size, self.range_bytes):
                ranges.append(ExportRange(path, start, min(start + self.range_bytes, size), place))
        return ranges or [D.InputPartition(None)]

    def _records(self, part: ExportRange):
        system, path = _file_system(part.path)
        if part.stop is None:
            codec = "gzip" if path.endswith(".gz") else "zstd"
            with system.open_input_stream(path, compression=codec) as stream:
                yield from read_records(stream, 0, True)
            return
        with system.open_input_file(path) as handle:
            yield from range_records(handle, part.start, part.stop, True)

    def read(self, partition):
        import pyarrow as pa

        if not isinstance(partition, ExportRange):
            return
        names = [*LAYOUT, *(f"f{i}" for i in self.keep)]
        for _, records in self._records(partition):
            place = [pa.repeat(pa.scalar(v, pa.string()), len(records)) for v in partition.place]
            columns = split_columns(pa.array(records, pa.binary()), self.keep)
            yield pa.RecordBatch.from_arrays([*place, *columns], names=names)


class ExportSource(D.DataSource):
    """``format("fleet_export")``: layout columns and fields ``f0, f1, …`` of a committed export."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        kept = [f"f{i} binary" for i in self.options["keep"].split(",") if i]
        return ", ".join([*(f"`{c}` string" for c in LAYOUT), *kept])

    def reader(self, schema):
        return ExportReader(self.options)

    def writer(self, schema, overwrite):
        return ExportWriter(self.options)


def write_export(
    rows: DataFrame, root: str, name: str, places: dict[str, Column], position: str | None = None,
    compression: str = "none",
) -> None:
    """Write ``rows`` as the export ``name`` of ``root``: all of it with its position, or nothing.

    ``places`` has an expression for each column of ``LAYOUT``. Rows are not shuffled, only sorted by place
    within their tasks.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ExportSource)
    place = [F.coalesce(places[c].cast("string"), F.lit(NO_VALUE)).alias(c) for c in LAYOUT]
    lines = rows.select(*place, dump_line(rows).cast("string").alias("value")).sortWithinPartitions(*LAYOUT)
    options = {"name": name, "run": uuid.uuid4().hex, "compression": compression, "rowschema": rows.schema.json()}
    if position is not None:
        options["position"] = position
    lines.write.format(FORMAT).options(**options).mode("append").save(qualified(spark, root))


def read_export(
    spark: SparkSession, root: str, name: str, columns: list[str] | None = None,
    only: dict[str, list[str]] | None = None, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Layout columns and typed columns of a committed export; fields of other ``columns`` are not unescaped.

    ``only`` names the wanted values of layout columns: files of other places are not opened. A filter on
    these columns gives the same rows but reads all files, as Spark 4.1 keeps the filters that it pushed into a
    Python source for later queries on the same DataFrame, which then lack rows; so none are taken.
    A column that is named like a layout column hides it.
    """
    wanted = {c: [str(v) for v in values] for c, values in (only or {}).items()}
    if not wanted.keys() <= set(LAYOUT):
        raise ValueError(f"places are told by {LAYOUT}")
    spark.dataSource.register(ExportSource)
    path = qualified(spark, root)
    fields = T.StructType.fromJson(json.loads(read_manifest(path, name)[0]["schema"])).fields
    kept = [(i, f) for i, f in enumerate(fields) if columns is None or f.name in columns]
    options = {
        "name": name, "keep": ",".join(str(i) for i, _ in kept), "rangebytes": str(range_bytes),
        "only": json.dumps(wanted),
    }
    records = spark.read.format(FORMAT).options(**options).load(path)
    taken = {f.name for _, f in kept}
    return records.select(
        *[c for c in LAYOUT if c not in taken], *[typed_field(F.col(f"f{i}"), f.dataType).alias(f.name) for i, f in kept]
    )


def export_commits(spark: SparkSession, root: str) -> DataFrame:
    """All lines of the manifests that stand in ``root``: a line with ``file`` null per export, and one per file."""
    lines = spark.read.schema(_MANIFEST).json(f"{qualified(spark, root)}/{COMMITS}")
    newest = lines.groupBy("name").agg(F.max("version").alias("version"))
    return lines.join(newest, ["name", "version"], "left_semi")


def sweep(spark: SparkSession, root: str, before: datetime.datetime) -> list[str]:
    """Delete run folders that no manifest names and in which nothing was written since ``before``.

    ``before`` (with a zone) lies before the start of every run that may still be going. Returns what was deleted.
    """
    from pyarrow import fs

    system, path = _file_system(qualified(spark, root))
    top = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    runs = {f.base_name: f for f in top if f.base_name.startswith(".run-")}
    # Folders are looked up before manifests, so one that is committed meanwhile counts as named.
    kept = {r["folder"] for r in export_commits(spark, root).where("file IS NULL").select("folder").collect()} if any(
        f.base_name == COMMITS for f in top
    ) else set()
    gone = []
    for name, info in sorted(runs.items()):
        if name in kept:
            continue
        below = system.get_file_info(fs.FileSelector(info.path, recursive=True))
        if all(f.mtime < before for f in [info, *below]):
            system.delete_dir(info.path)
            gone.append(name)
    return gone
