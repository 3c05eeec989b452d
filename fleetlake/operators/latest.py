"""Latest-per-key and keyed upsert.

A ``row_number() = 1`` filter gets a group limit before the shuffle, so a hot key sends one row
per input task, never all its rows, to one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carry_last


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The newest rows of each key; rows tied at the newest time are all kept.

    The newest times are aggregated map-side, then select their rows by a semi-join. However
    many rows tie at one key, they may stay spread out: the join broadcasts a small list of
    keys and splits skewed partitions otherwise, which a rank window could not.
    """
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(newest, [*keys, ts], "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exactly one row per key, the first by ``order`` (which must break all ties)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(window)).where("__row = 1").drop("__row")


def top_rows(df: DataFrame, order: Sequence[Column], n: int = 1) -> DataFrame:
    """``ORDER BY … LIMIT n``: a top-n report."""
    return df.orderBy(*order).limit(n)


def newest_value(df: DataFrame, keys: Sequence[str], ts: str, out: str) -> DataFrame:
    """The newest time per key."""
    return df.groupBy(*keys).agg(F.max(ts).alias(out))


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    mode: str = "replace",
) -> DataFrame:
    """Target after the changes. ``replace``: the last row of a key wins; ``ignore``: the first does.

    Target rows precede all changes; changes are ordered by ``seq``.
    """
    if mode not in ("replace", "ignore"):
        raise ValueError(f"unknown upsert mode {mode}")
    both = target.withColumn("__source", F.lit(0)).unionByName(
        changes.select(*target.columns).withColumn("__source", F.lit(1))
    )
    order = [F.col("__source"), *[F.col(c) for c in seq]]
    if mode == "replace":
        order = [c.desc() for c in order]
    return first_per_key(both, keys, order).drop("__source")


def overlay(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all layers; where a key is in several, the later layer's row wins."""
    ranked = None
    for level, layer in enumerate(layers):
        part = layer.withColumn("__level", F.lit(level))
        ranked = part if ranked is None else ranked.unionByName(part)
    return first_per_key(ranked, keys, [F.col("__level").desc()]).drop("__level")


def latest_fields(
    updates: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Current value of every field per key: the last update that gave the field a value."""
    position = F.struct(*[F.col(c) for c in order])
    return updates.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in fields]
    )


def progress_history(
    updates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    slice_col: Column,
) -> DataFrame:
    """State of every field after each update, for jobs whose updates touch some fields only."""
    current = {f"current_{c}": F.col(c) for c in fields}
    return carry_last(updates, keys, order, slice_col, current)


def newest_valid_backup(
    objects: DataFrame,
    replica_set: str,
    created: str,
    modified: str,
    as_of: Column,
    days: int = 5,
    sources: Column | None = None,
) -> DataFrame:
    """The backup to restore per replica set: newest day within ``days``, then latest modified.

    ``sources`` limits the rows to allowed sources (logical backups are not taken from masters).
    """
    usable = objects.where(
        (F.col(created) <= F.to_date(as_of)) & (F.col(created) > F.date_sub(F.to_date(as_of), days))
    )
    if sources is not None:
        usable = usable.where(sources)
    tie = [F.col(c) for c in objects.columns if c not in (replica_set, created, modified)]
    return first_per_key(usable, [replica_set], [F.col(created).desc(), F.col(modified).desc(), *tie])


def unarchived_logs(
    logs: DataFrame, logged: DataFrame, stored: DataFrame, instance: str, log: str
) -> DataFrame:
    """Every log but each instance's newest, with what is left to do.

    ``upload``: neither logged nor stored; ``record``: stored but not logged. Logs already
    logged as uploaded are dropped.
    """
    newest = logs.groupBy(instance).agg(F.max(log).alias("__newest"))
    closed = logs.join(newest, instance).where(F.col(log) < F.col("__newest")).drop("__newest")
    todo = closed.join(logged.select(instance, log).distinct(), [instance, log], "left_anti")
    found = stored.select(instance, log).distinct().withColumn("__stored", F.lit(True))
    return (
        todo.join(found, [instance, log], "left")
        .withColumn("action", F.when(F.col("__stored"), "record").otherwise("upload"))
        .drop("__stored")
    )


def prune(df: DataFrame, ts: str, keep: Column, as_of: Column) -> DataFrame:
    """Rows still inside the retention."""
    return df.where(F.col(ts) >= as_of - keep)
