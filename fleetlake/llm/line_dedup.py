"""Deletion of repeated runs of lines, by winnowing over line hashes.

A document is the sequence of its lines that hold a word. Around each line two windows reach just as far
as to hold ``words`` words, one forward and one back. The least line hash of a window is its fingerprint;
two documents that share a run of that many words share a whole window, and so its fingerprint: the
minima are guaranteed to meet. Only windows whose fingerprint occurs at two places or more go on. They
meet by content: where a window's lines occurred earlier, in an earlier document or further up, the match
is extended both ways by the neighbouring windows that match too, and the lines of all of them are
deleted. Every line of a repeated run of ``words`` words or more lies in such a window, whichever
document the run came from, so whole runs go and shorter repeats stay.

Documents are ordered by id. Groups of equal windows are only ever reduced to their first place, and
places are then joined to it: no pairs. Windows of a document are made by window functions over its own
lines, hashes and counts alone; texts move once, to be cut. All of it is column expressions.

Defined cases: a null text has no line and stays null. Rows with the same id and text are one document:
they are cut alike. Null ids come last in order, equal ids go by their texts' hashes. Line ends are \\n; lines are compared
as they are. A line without a word is deleted with the run around it. Extra columns are kept. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .mixing import WORD

#: Words that a repeated run has at least.
WORDS = 50


def _key(key: str, text: str) -> dict[str, Column]:
    return {"__k1": F.xxhash64(key, text), "__k2": F.hash(key, text)}


def windows(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """The windows of all documents: place (which is ordered), i, j (lines), w1, w2 (content), print, at."""
    line = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")),
    )
    ks = ["__k1", "__k2"]
    lines = (
        docs.where(F.col(text).isNotNull())
        .select(*[c.alias(n) for n, c in _key(key, text).items()], F.col(key).alias("__id"), line.alias("__lines"))
        .groupBy(*ks)
        .agg(F.first("__id").alias("__id"), F.first("__lines").alias("__lines"))
        .select(*ks, "__id", F.posexplode("__lines").alias("pos", "line"))
        .select(*ks, "__id", "pos", "line.h", F.col("line.w").cast("long").alias("w"))
        .where("w > 0")
    )
    own = Window.partitionBy(*ks)
    summed = lines.withColumn("upto", F.sum("w").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    summed = summed.withColumns({"ahead": F.col("upto") - F.col("w"), "total": F.sum("w").over(own)}).where(
        F.col("total") >= words
    )
    # Lines with fewer than ``words`` words between their start, or end, and this line's.
    forward = own.orderBy("ahead").rangeBetween(0, words - 1)
    back = own.orderBy("upto").rangeBetween(1 - words, 0)
    spanned = summed.withColumn("fore", F.collect_list(F.struct("h", "pos")).over(forward)).withColumn(
        "aft", F.collect_list(F.struct("h", "pos")).over(back)
    )

    def window(lines: str, fits: Column) -> Column:
        hashes = F.transform(lines, lambda x: x["h"])
        least = F.array_min(lines)
        return F.when(
            fits,
            F.struct(
                F.array_min(F.transform(lines, lambda x: x["pos"])).alias("i"),
                F.array_max(F.transform(lines, lambda x: x["pos"])).alias("j"),
                F.xxhash64(hashes).alias("w1"),
                F.hash(hashes).alias("w2"),
                least["h"].alias("print"),
                least["pos"].alias("at"),
            ),
        )

    both = F.array_compact(
        F.array_distinct(
            F.array(
                window("fore", F.col("total") - F.col("ahead") >= words), window("aft", F.col("upto") >= words)
            )
        )
    )
    return spanned.select(*ks, "__id", F.explode(both).alias("x")).select(*ks, "__id", "x.*")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per document (``__k1``, ``__k2``) the runs of lines to delete, as an ordered array of (i, j)."""
    made = materialize(windows(docs, key, text, words), "line-windows")
    ks = ["__k1", "__k2"]
    where = F.struct(*ks, "at")
    prints = (
        made.groupBy("print")
        .agg(F.min(where).alias("low"), F.max(where).alias("high"))
        .where("low <> high")
        .select("print")
    )
    place = F.struct(F.col("__id").isNull().alias("none"), F.col("__id"), F.col("__k1"), F.col("__k2"), F.col("i"), F.col("j"))
    candidates = made.join(prints, "print", "left_semi").withColumn("place", place)
    firsts = (
        candidates.groupBy("w1", "w2")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where("first <> last")
        .select("w1", "w2", "first")
    )
    later = candidates.join(firsts, ["w1", "w2"]).where("place > first").select(*ks, "i", "j").distinct()
    own = Window.partitionBy(*ks).orderBy("i", "j")
    reach = F.max("j").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("i") > reach + 1), 1).otherwise(0)
    return (
        later.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*ks, "run")
        .agg(F.min("i").alias("i"), F.max("j").alias("j"))
        .groupBy(*ks)
        .agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("__cuts"))
    )


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, removed: str = "n_removed") -> DataFrame:
    """``docs`` with the later repeats cut out of ``text``, and the number of lines deleted as ``removed``."""
    columns = [c for c in docs.columns if c != removed]
    keyed = docs.select(*columns, *[c.alias(n) for n, c in _key(key, text).items()])
    found = keyed.join(repeats(docs, key, text, words).hint("shuffle_hash"), ["__k1", "__k2"], "left")
    lines = F.split(text, "\n")
    # What stays lies between the runs: after each of them, and ahead of the first, up to the next.
    kept = F.transform(
        F.sequence(F.lit(0), F.size("__cuts")),
        lambda x: F.slice(
            "__all",
            F.when(x == 0, 1).otherwise(F.get("__cuts", x - 1)["j"] + 2),
            F.coalesce(F.get("__cuts", x)["i"], F.size("__all"))
            - F.when(x == 0, 0).otherwise(F.get("__cuts", x - 1)["j"] + 1),
        ),
    )
    lost = F.aggregate("__cuts", F.lit(0).cast("long"), lambda a, c: a + c["j"] - c["i"] + 1)
    return (
        found.withColumn("__all", F.when(F.col("__cuts").isNotNull(), lines))
        .withColumn(text, F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(kept), "\n")))
        .withColumn(removed, F.when(F.col("__cuts").isNull(), F.lit(0).cast("long")).otherwise(lost))
        .select(*columns, removed)
    )
