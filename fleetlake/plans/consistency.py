"""Replica consistency audit: cheap chunk checksums first, rows only where that pays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import consistency as C
from ..session import materialize


def audit_rows(
    source: DataFrame,
    replica: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    chunk: Column,
    *,
    chunk_errors: int = 0,
    chunk_skips: int = 0,
    min_diffs: int = C.MIN_DIFFS,
    max_diffs: int = C.MAX_DIFFS,
) -> tuple[DataFrame, DataFrame]:
    """(one-row summary of chunks, differing rows of all chunks that differ).

    The row check shuffles only the rows of differing chunks. However many differ, their rows are
    compared; ``max_diffs`` only decides what the status calls them.
    """
    # Written once: the checksums read both tables whole, and the list is used three times.
    chunks = materialize(C.chunk_diff(source, replica, chunk, columns), "chunks")
    summary = chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("master_cnt").alias("row_count"),
        F.count_if("differs").alias("chunk_diffs"),
        F.lit(chunk_errors).alias("chunk_errors"),
        F.lit(chunk_skips).alias("chunk_skips"),
    )
    counts = [F.col(c) for c in ("chunk_errors", "chunk_diffs", "chunk_skips")]
    checked = F.col("chunk_diffs") > 0
    suspect = chunks.where("differs").select(F.col("chunk").alias("__chunk"))
    summary = summary.withColumns(
        {
            "rows_checked": F.when(checked, "YES").otherwise("NO"),
            "checksum_status": C.checksum_status(*counts, min_diffs, max_diffs),
        }
    )
    ours = source.withColumn("__chunk", chunk).join(suspect, "__chunk", "left_semi")
    theirs = replica.withColumn("__chunk", chunk).join(suspect, "__chunk", "left_semi")
    return summary, C.row_diff(ours, theirs, keys, columns)


def audit(
    source: DataFrame,
    replica: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    chunk: Column,
    *,
    labels: dict[str, str],
    **limits,
) -> DataFrame:
    """One ``checksum_detail`` row for one table on one replica."""
    summary, rows = audit_rows(source, replica, keys, columns, chunk, **limits)
    kinds = rows.agg(
        F.count(F.lit(1)).alias("row_diffs"),
        *[F.count_if(F.col("change") == k).alias(f"rows_to_{k}") for k in ("insert", "delete", "update")],
    )
    # Two rows, one with the summary's columns and one with the counts, fold into one.
    both = summary.unionByName(kinds, allowMissingColumns=True)
    whole = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return whole.withColumns({k: F.lit(v) for k, v in labels.items()})
