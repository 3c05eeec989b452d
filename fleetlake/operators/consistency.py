"""Chunk checksums, row differences and the status of a replica comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key

# Bounds on differing chunks between which rows are compared.
MIN_DIFFS = 1
MAX_DIFFS = 5
# 15 hex digits of an md5 are 60 bits: they fit a signed long.
_DIGEST_HEX = 15


def row_digest(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two times 60 bits of the md5 over all columns of a row.

    Every field goes in with its length, and null as a mark that no length begins with, so rows that
    differ are different texts. Not a CRC: CRC is linear, so XOR over rows would cancel systematic
    differences.
    """
    texts = [F.col(c).cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("N")) for t in texts]
    digest = F.md5(F.concat(*fields).cast("binary"))
    high, low = (F.conv(F.substring(digest, at, _DIGEST_HEX), 16, 10).cast("long") for at in (1, 1 + _DIGEST_HEX))
    return high, low


def chunk_checksums(df: DataFrame, chunk: Column, columns: Sequence[str]) -> DataFrame:
    """Row count and checksum (a pair of numbers) per chunk, combined before the shuffle."""
    high, low = row_digest(columns)
    return df.groupBy(chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("cnt"), F.struct(F.bit_xor(high).alias("high"), F.bit_xor(low).alias("low")).alias("crc")
    )


def differs(master_cnt: Column, this_cnt: Column, master_crc: Column, this_crc: Column) -> Column:
    """Counts differ, or checksums differ, or exactly one side has no checksum."""
    return (~master_cnt.eqNullSafe(this_cnt)) | (~master_crc.eqNullSafe(this_crc))


def chunk_diff(source: DataFrame, replica: DataFrame, chunk: Column, columns: Sequence[str]) -> DataFrame:
    """Both sides' chunks next to each other, with ``differs``."""
    ours = chunk_checksums(source, chunk, columns)
    theirs = chunk_checksums(replica, chunk, columns)
    both = ours.withColumnsRenamed({"cnt": "master_cnt", "crc": "master_crc"}).join(
        theirs.withColumnsRenamed({"cnt": "this_cnt", "crc": "this_crc"}), "chunk", "full_outer"
    )
    both = both.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("master_cnt", "this_cnt")}
    )
    state = differs(*[F.col(c) for c in ("master_cnt", "this_cnt", "master_crc", "this_crc")])
    return both.withColumn("differs", state)


def chunk_summary(chunks: DataFrame, keys: Sequence[str] = ("db", "tbl")) -> DataFrame:
    """Differing chunks and total time in ms per table."""
    state = differs(*[F.col(c) for c in ("master_cnt", "this_cnt", "master_crc", "this_crc")])
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_if(state).alias("chunk_diffs"),
        F.round(F.sum("chunk_time") * 1000).cast("long").alias("elapsed_time_ms"),
    )


def row_diff(
    source: DataFrame, replica: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Keys whose rows differ and what would mend the replica: insert, delete or update.

    Keys are unique on each side. Columns are compared value by value, null-safe.
    """
    ours = source.select(*keys, F.struct(*columns).alias("__ours"))
    theirs = replica.select(*keys, F.struct(*columns).alias("__theirs"))
    both = ours.join(theirs, list(keys), "full_outer")
    kind = (
        F.when(F.col("__theirs").isNull(), "insert")
        .when(F.col("__ours").isNull(), "delete")
        .when(~F.col("__ours").eqNullSafe(F.col("__theirs")), "update")
    )
    return both.select(*keys, kind.alias("change")).where(F.col("change").isNotNull())


def checksum_status(
    errors: Column,
    diffs: Column,
    skips: Column,
    min_diffs: int = MIN_DIFFS,
    max_diffs: int = MAX_DIFFS,
) -> Column:
    """Status of one table on one replica, as recorded when the comparison ends."""
    doubtful = diffs + skips
    return (
        F.when(errors > 0, "ERRORS_IN_CHECKSUM_PROCESS")
        .when(doubtful == 0, "GOOD")
        .when(doubtful > max_diffs, "TOO_MANY_CHUNK_DIFFS")
        .when(doubtful < min_diffs, "CHUNK_DIFFS_FOUND_BUT_OK")
        .when(diffs > 0, "ROW_DIFFS_FOUND")
        .otherwise("CHUNKS_WERE_SKIPPED")
    )


def rows_are_checked(errors: Column, diffs: Column, skips: Column, min_diffs: int = MIN_DIFFS, max_diffs: int = MAX_DIFFS) -> Column:
    """Whether the comparison goes on to rows."""
    doubtful = diffs + skips
    return (errors <= 0) & (doubtful >= min_diffs) & (doubtful <= max_diffs) & (doubtful != 0)


def reported_status(status: Column, rows_checked: Column, row_diffs: Column) -> Column:
    """Status as reported: chunk differences whose rows turned out equal are good."""
    cleared = (status == "ROW_DIFFS_FOUND") & (rows_checked == "YES") & (row_diffs == 0)
    return F.when(cleared, "GOOD").otherwise(status)


def rotating_sample(df: DataFrame, key: str, fraction: int, day: Column) -> DataFrame:
    """The 1/``fraction`` of keys due on a day; every key is due once in ``fraction`` days.

    A key's turn is a hash of the key, so no list of all keys is ever numbered.
    """
    hashed = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10)
    return df.where(F.pmod(hashed.cast("long"), F.lit(fraction)) == F.dayofyear(day) % fraction)


def latest_reports(detail: DataFrame) -> DataFrame:
    """Newest comparison of each table on each replica, with the reported status."""
    newest = latest_per_key(detail, ["master_instance", "instance", "db", "tbl"], "reported_at")
    status = reported_status(F.col("checksum_status"), F.col("rows_checked"), F.col("row_diffs"))
    return newest.withColumn("checksum_status", status)
