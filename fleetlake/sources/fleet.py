"""The same table from many servers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_fleet_table(
    spark: SparkSession, instances: Mapping[str, Mapping[str, str]], fmt: str = "jdbc"
) -> DataFrame:
    """Union of one table over all instances, with an ``instance`` column.

    ``instances`` gives the reader options of each; for ``jdbc`` these are url, dbtable, user
    and password, and partitionColumn with its bounds for large tables.
    """
    parts = [
        spark.read.format(fmt).options(**options).load().withColumn("instance", F.lit(name))
        for name, options in instances.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_servers(
    servers: DataFrame, fetch: Callable[[str, dict[str, str]], Iterator], schema: T.StructType, tasks: int
) -> DataFrame:
    """Rows of one table from every server of ``servers`` (instance, options map), as one plan of ``tasks`` tasks.

    ``fetch(instance, options)`` runs in the task and yields Arrow record batches with the columns of
    ``schema``, by name; columns beyond them are left out. The result adds ``instance`` and ``error``. A server
    that fails, at its connection or halfway, adds a row with its error and nulls and stops no other one;
    ``whole_servers`` leaves out what it gave before. However many servers there are, the plan is the same.
    """
    full = T.StructType([*schema.fields, T.StructField("instance", T.StringType()), T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]
    if {"instance", "error"} & set(names):
        raise ValueError("instance and error name columns that the reader adds")
    nulls = T.StructType([T.StructField(f.name, f.dataType, True) for f in full.fields])

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(nulls)
        for batch in batches:
            for server in batch.to_pylist():
                instance = server["instance"]
                try:
                    for found in fetch(instance, dict(server["options"] or {})):
                        n = found.num_rows
                        given = [found.column(found.schema.get_field_index(c)).cast(shape.field(c).type) for c in names]
                        marks = [pa.repeat(pa.scalar(instance, pa.string()), n), pa.nulls(n, pa.string())]
                        yield pa.RecordBatch.from_arrays([*given, *marks], schema=shape)
                except Exception as error:  # noqa: BLE001 - whatever a server's driver raises is that server's row
                    said = f"{type(error).__name__}: {error}"
                    row = {**dict.fromkeys(names), "instance": instance, "error": said}
                    yield pa.RecordBatch.from_pylist([row], schema=shape)

    return servers.select("instance", "options").repartition(tasks).mapInArrow(read, nulls)


def whole_servers(rows: DataFrame) -> DataFrame:
    """Rows of the servers that were read to their end, without the error column."""
    failed = rows.where("error IS NOT NULL").select("instance").distinct()
    return rows.join(failed, "instance", "left_anti").drop("error")
