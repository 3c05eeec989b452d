"""A keyed table in Parquet that streams and batches can merge into.

A merge writes the rows it brings, one per key, into a folder of its own, and nothing else; a small marker,
renamed into place after the folder is complete, makes it a part of the table. Reading takes the newest row of
each key over all parts. Now and then the parts are compacted into a base, named by a marker in the same way.

A merge or compaction that dies leaves no marker: what was there stays as it was, and stays readable. A batch that is
repeated under its number replaces its earlier folder, so streams may run a batch twice. Reading costs a
shuffle of what the parts hold; ``compact_after`` bounds the parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.latest import first_per_key

BATCH = "__batch"
_OWN = "merge"


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Spans of whole numbers, those that touch put together."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


class KeyedTable:
    """``keys`` name a row; the row with the greatest ``seq`` counts, and of equal ones the one merged under the least number."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], seq: Sequence[str], compact_after: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.seq, self.compact_after = list(keys), list(seq), compact_after

    def _at(self, *parts: str):
        """File system and path of a place in the table."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _markers(self) -> list[dict]:
        """The markers there are: a base or a batch each."""
        system, place = self._at("parts")
        if not system.exists(place):
            return []
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        found = []
        for status in system.listStatus(place):
            if status.getPath().getName().startswith("_"):
                continue
            stream = system.open(status.getPath())
            try:
                found.append(json.loads(read(stream, "UTF-8")))
            finally:
                stream.close()
        return found

    def _mark(self, marker: dict) -> None:
        """Make a finished folder a part of the table, in one rename."""
        system, place = self._at("parts", marker["folder"])
        _, draft = self._at("parts", f"_{marker['folder']}")
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps(marker).encode()))
        stream.close()
        if not system.rename(draft, place):
            raise OSError(f"could not name {marker['folder']}")

    def _current(self) -> tuple[dict | None, dict[tuple[str, int], dict]]:
        """The newest base, and the batches it does not hold: of each the last attempt."""
        markers = self._markers()
        bases = [m for m in markers if m["kind"] == "base"]
        base = max(bases, key=lambda m: m["attempt"], default=None)
        batches: dict[tuple[str, int], dict] = {}
        for m in sorted((m for m in markers if m["kind"] == "batch"), key=lambda m: m["attempt"]):
            if not self._covered(base, m["writer"], m["number"]):
                batches[m["writer"], m["number"]] = m
        return base, batches

    @staticmethod
    def _covered(base: dict | None, writer: str, number: int) -> bool:
        return base is not None and any(low <= number <= high for low, high in base["covers"].get(writer, []))

    def exists(self) -> bool:
        base, batches = self._current()
        return base is not None or bool(batches)

    def _rows(self, parts: Sequence[dict]) -> DataFrame:
        """The newest row of each key over ``parts``, with the number of the merge that brought it."""
        schema = T.StructType.fromJson(json.loads(parts[-1]["schema"]))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{p['folder']}" for p in parts])
        return first_per_key(rows, self.keys, [*[F.col(c).desc() for c in self.seq], F.col(BATCH)])

    def read(self) -> DataFrame:
        """The rows there are."""
        base, batches = self._current()
        parts = [p for p in (base, *batches.values()) if p]
        if not parts:
            raise FileNotFoundError(f"nothing was merged into {self.path}")
        return self._rows(parts).drop(BATCH)

    def merge(self, changes: DataFrame, mode: str = "replace", number: int | None = None, writer: str = _OWN) -> None:
        """Apply changes. With ``replace`` a change not newer than the stored row is ignored, so batches may come out of
        order; with ``ignore`` the stored row stays.

        ``number`` names a batch of ``writer`` (say, of a stream): merged again, it replaces what it brought before. Without
        one the changes are a batch of their own.
        """
        if mode not in ("replace", "ignore"):
            raise ValueError(f"unknown upsert mode {mode}")
        base, batches = self._current()
        if number is None:
            taken = [n for w, n in batches if w == writer] + [high for _, high in (base["covers"].get(writer, []) if base else [])]
            number = max(taken, default=-1) + 1
        elif self._covered(base, writer, number):
            return  # what it brought is in the base
        order = [F.col(c).desc() if mode == "replace" else F.col(c) for c in self.seq]
        one = first_per_key(changes, self.keys, order)
        others = [p for p in (base, *(m for at, m in batches.items() if at != (writer, number))) if p]
        if mode == "ignore" and others:
            held = self._rows(others).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
            one = one.join(held, same, "left_anti")
        old = batches.get((writer, number))
        attempt = old["attempt"] + 1 if old else 0
        self._write(one.withColumn(BATCH, F.lit(number).cast("long")), {"kind": "batch", "writer": writer, "number": number, "attempt": attempt})
        if old:
            self._remove(old)
        if len(batches) + (old is None) >= self.compact_after:
            self.compact()

    def _write(self, rows: DataFrame, marker: dict) -> None:
        folder = f"{marker['kind']}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/rows/{folder}")
        self._mark(marker | {"folder": folder, "schema": rows.schema.json()})

    def _remove(self, part: dict) -> None:
        for place in (("parts", part["folder"]), ("rows", part["folder"])):
            system, path = self._at(*place)
            system.delete(path, True)

    def compact(self) -> None:
        """Write all parts as one base. The parts stay for those who still read them, and go with the next compaction."""
        base, batches = self._current()
        parts = [p for p in (base, *batches.values()) if p]
        if len(parts) < 2:
            return
        markers = self._markers()
        covers: dict[str, list[list[int]]] = {w: list(spans) for w, spans in (base["covers"] if base else {}).items()}
        for writer, number in batches:
            covers.setdefault(writer, []).append([number, number])
        merged = {w: _joined(spans) for w, spans in covers.items()}
        self._write(self._rows(parts), {"kind": "base", "attempt": base["attempt"] + 1 if base else 0, "covers": merged})
        for m in markers:
            outdated = m["attempt"] < base["attempt"] if m["kind"] == "base" and base else self._covered(base, m.get("writer", ""), m.get("number", -1))
            if outdated:
                self._remove(m)
