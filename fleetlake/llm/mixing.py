"""Mixing sources to target weights.

A source's documents, in pseudorandom order, are one stream of words, cut into blocks of fixed length.
The output is a number of shards of block slots. For each shard a multinomial draw shares its slots out
over the sources, by what each has left of its target; a source's slots are counted on from shard to
shard, and slot number maps to block number by a pseudorandom permutation of the source's whole blocks,
a new one for each pass over the source. Slots and blocks are then joined by source and block number.

A source's targets are met to the word: the last block of a pass is short if its words are not a
multiple of the block length, and the last slot of a source is cut where the target is reached. So no
document is taken more often than its source has passes, which the cap on targets limits.

Word offsets of a stream come from sums per (source, bucket of documents), so a source that holds most
rows is still worked on in pieces. What the driver holds is a line per source and per (shard, source):
the mixture's configuration, with at most ``SHARDS`` shards.

Defined cases: a null text has no words; a null source is a source, last in order. Order, draws and
permutations depend on the seed and on the documents alone, so reruns agree; equal rows are
interchangeable. An empty table, or one without a word, gives no blocks and takes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .words import mix64

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCK = 1024
SHARD_SLOTS, SHARDS = 4096, 1024
ROWS_PER_BUCKET, LEAST_BUCKETS = 50_000, 64
SEED = 7


def shares(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """``total`` by weight, none above ``cap`` times its size; the excess is shared out again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def slot_count(size: int, wanted: int, block: int) -> int:
    """Slots that hold ``wanted`` words of a source of ``size`` words."""
    if not size or not wanted:
        return 0
    passes, rest = divmod(wanted, size)
    return passes * -(-size // block) + -(-rest // block)


def draws(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws by what the sources have left."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for shard in range(shards):
        need = int(left.sum()) // (shards - shard)
        while need:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[shard] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 applied to ``index``, which has to be inside: a four-round
    Feistel network that walks its cycle until it is inside again."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> b, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix64(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) & m)
        out[todo] = left << b | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def sized(docs: DataFrame, text: str = "text", into: str = "size") -> DataFrame:
    """``docs`` with the number of words of ``text``."""
    return docs.withColumn(into, F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def targets(rows: DataFrame, source: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[tuple]:
    """(source, size, target) of each source by code point, null last; ``rows`` have a column ``size``."""
    sums = rows.groupBy(F.col(source).alias("s")).agg(F.sum("size").alias("n")).orderBy(F.col("s").asc_nulls_last())
    found = [(r["s"], int(r["n"])) for r in sums.collect()]
    sizes = [n for _, n in found]
    own = [float(weights[i % len(weights)]) for i in range(len(found))]
    wanted = shares(sizes, own, share * sum(sizes), cap)
    return [(s, n, t) for (s, n), t in zip(found, wanted, strict=True)]


def slots(rows: DataFrame, plan: list[tuple], source: str, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixture: source, shard, slot, pass, block, words (taken from the block's start)."""
    spark = rows.sparkSession
    wanted = [min(round(t), int(CAP * n) if n else 0) for _, n, t in plan]
    counts = [slot_count(n, w, block) for (_, n, _), w in zip(plan, wanted, strict=True)]
    shards = min(SHARDS, max(1, math.ceil(sum(counts) / SHARD_SLOTS)))
    drawn = draws(counts, shards, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    table = [
        (plan[s][0], s, plan[s][1], wanted[s], counts[s], shard, int(first[shard, s]), int(drawn[shard, s]))
        for shard in range(shards)
        for s in range(len(plan))
        if drawn[shard, s]
    ]
    kind = rows.schema[source].dataType
    names = [(source, kind)] + [(n, T.LongType()) for n in ("number", "size", "wanted", "count", "shard", "first", "drawn")]
    given = spark.createDataFrame(table, T.StructType([T.StructField(n, k) for n, k in names]))

    @F.arrow_udf("long")
    def place(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for index, size, key in batches:
            yield pa.array(permute(index.to_numpy(), size.to_numpy(), key.to_numpy()))

    whole, blocks = F.floor(F.col("size") / block), F.ceil(F.col("size") / block)
    return (
        given.repartition("shard", "number")
        .withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("drawn") - 1)))
        .withColumns({"whole": whole, "pass": F.floor(F.col("slot") / blocks), "place": F.pmod("slot", blocks)})
        .withColumn(
            "block",
            F.when(
                F.col("place") < F.col("whole"),
                # Python sees every row, so a place outside the permutation is moved into it.
                place(
                    F.least("place", F.greatest(F.col("whole") - 1, F.lit(0))),
                    F.greatest("whole", F.lit(1)),
                    F.xxhash64(F.lit(seed), "number", "pass"),
                ),
            ).otherwise(F.col("whole")),
        )
        .withColumn("full", F.least(F.lit(block), F.col("size") - F.col("block") * block))
        .withColumn(
            "words",
            F.least("full", F.col("wanted") - F.col("pass") * F.col("size") - F.col("place") * block),
        )
        .select(source, "shard", "slot", "pass", "block", "words")
    )


def offsets(rows: DataFrame, source: str, order: list[str], total_rows: int, seed: int = SEED) -> DataFrame:
    """``rows`` with the place of each one's first word in its source's stream as ``offset``."""
    buckets = max(LEAST_BUCKETS, -(-total_rows // ROWS_PER_BUCKET))
    keyed = rows.withColumn("__hash", F.xxhash64(F.lit(seed), *order)).withColumn(
        "__bucket", F.pmod("__hash", F.lit(buckets))
    )
    by_source = Window.partitionBy(source).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(source, "__bucket")
        .agg(F.sum("size").alias("__words"))
        .withColumn("__start", F.coalesce(F.sum("__words").over(by_source), F.lit(0)))
        .select(F.col(source).alias("__source"), F.col("__bucket").alias("__b"), "__start")
    )
    inside = Window.partitionBy(source, "__bucket").orderBy("__hash", *order, "row")
    running = keyed.withColumn("__upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(
        starts, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b"))
    ).select(*rows.columns, (F.col("__start") + F.col("__upto") - F.col("size")).alias("offset"))


def taken(
    rows: DataFrame, plan: list[tuple], source: str, order: list[str], total_rows: int, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """What the mixture takes of each row: row, pass, shard, slot, at (place in the slot), start, end (words of the document).

    ``rows`` have a unique number ``row`` and a ``size``, and are a stored table: they are read twice.
    """
    placed = offsets(rows.where("size > 0"), source, order, total_rows, seed)
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), last))).select(
        "row", "size", "offset", "block", F.col(source).alias("__source")
    )
    mixture = slots(rows, plan, source, block, seed).hint("merge")  # a row per block: it grows with the words
    start = F.greatest("offset", F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), F.col("block") * block + F.col("words"))
    return (
        pieces.join(mixture, F.col(source).eqNullSafe(F.col("__source")) & (pieces["block"] == mixture["block"]))
        .drop(mixture["block"])
        .withColumns({"at": start - F.col("block") * block, "start": start - F.col("offset"), "end": end - F.col("offset")})
        .where("end > start")
        .select("row", "pass", "shard", "slot", "at", "start", "end")
    )


def amounts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """For each row of ``docs``: key, size, source_size, target, taken (words), shards (those that its words go to, in order)."""
    spark = docs.sparkSession
    slim = sized(docs.select(key, text, source), text).select(
        F.monotonically_increasing_id().alias("row"), key, source, "size", F.xxhash64(text).alias("text_hash")
    )
    rows = materialize(slim, "mix-sizes")
    total = rows.count()
    plan = targets(rows, source)
    sums = (
        taken(rows, plan, source, [key, "text_hash"], total)
        .groupBy("row")
        .agg(F.sum(F.col("end") - F.col("start")).alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    )
    kind = T.StructType(
        [
            T.StructField("__source", rows.schema[source].dataType),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
        ]
    )
    known = spark.createDataFrame(plan, kind)
    return (
        rows.join(sums.hint("merge"), "row", "left")  # a row per document: never broadcast
        .join(known, F.col(source).eqNullSafe(F.col("__source")))
        .select(key, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
    )


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mixture itself: shard, slot, source, n_words, text. A row per slot, which is a block of ``block`` words but for
    the last of a pass over a source and of a source; words are joined by a space."""
    stored = materialize(docs.select(key, text, source, F.monotonically_increasing_id().alias("row")), "mix-documents")
    rows = materialize(sized(stored, text).select("row", key, source, "size", F.xxhash64(text).alias("text_hash")), "mix-sizes")
    pieces = taken(rows, targets(rows, source), source, [key, "text_hash"], rows.count(), block)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    cut = F.slice("__words", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    # A document's pieces come out of one split of its text; a slot gathers a block's words.
    own = pieces.groupBy("row").agg(F.collect_list(F.struct("shard", "slot", "at", "start", "end")).alias("__pieces"))
    placed = (
        stored.join(own.hint("merge"), "row")
        .select(source, words.alias("__words"), F.explode("__pieces").alias("p"))
        .select(source, "__words", "p.*")
        .select(source, "shard", "slot", F.struct("at", cut.alias("words")).alias("piece"))
    )
    filled = placed.groupBy("shard", source, "slot").agg(F.flatten(F.sort_array(F.collect_list("piece"))["words"]).alias("__words"))
    return filled.select("shard", "slot", source, F.size("__words").cast("long").alias("n_words"), F.array_join("__words", " ").alias("text"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: a row per document and pass, its ``text`` being the words taken, in order.

    A document taken whole keeps its text as it is; of a document cut by a block's border the taken
    runs of words are joined, white space after each word included.
    """
    columns = docs.columns
    stored = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-documents")
    rows = materialize(
        sized(stored, text).select(
            F.col("__row").alias("row"), key, source, "size", F.xxhash64(text).alias("text_hash")
        ),
        "mix-sizes",
    )
    plan = targets(rows, source)
    passes = (
        taken(rows, plan, source, [key, "text_hash"], rows.count())
        .groupBy("row", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__runs"))
        .join(rows.select("row", "size"), "row")
        .select(F.col("row").alias("__row"), "__runs", F.col("size").alias("__size"))
    )
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(
        F.flatten(
            F.transform(
                "__runs",
                lambda r: F.slice("__words", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")),
            )
        ),
        "",
    )
    lengths = F.aggregate("__runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return (
        stored.join(passes.hint("shuffle_hash"), "__row")
        .withColumn("__words", F.when(lengths < F.col("__size"), words))
        .withColumn(text, F.when(F.col("__words").isNull(), F.col(text)).otherwise(F.rtrim(cut)))
        .select(*columns)
    )
