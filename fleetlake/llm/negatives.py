"""Hard negatives from blocks of vectors in Hilbert order, chosen by zone maps.

Components are whole numbers, floor(scale * x); a score is the exact inner product. The rows of each label are
sorted along a Hilbert curve (dimensions of larger spread first, ``LEVELS`` bits each) and written as Parquet
blocks of at most ``BLOCK`` rows, each with its zone map: least and largest component per dimension, and
labels. Anchors go into chunks of ``CHUNK`` the same way, so that those of a chunk want similar blocks.

By interval arithmetic an anchor's scores with all rows of a block lie between the sums of the least and
the largest products per dimension. These bounds choose the blocks that are read:

1. Positives: of each group of zone maps the ``FIRST`` blocks of the anchor's label with the highest upper bounds are
   read, which gives the score to beat; then every other block whose upper bound reaches it.
2. Negatives: a positive's window runs from ``low`` hundredths of its score up to the score. Blocks of other labels whose
   bounds meet a window are read, those with the highest upper bounds first; then those that can still improve on
   what was found.

Chunks meet zone maps in groups of ``ZONES``, and then the blocks chosen for any anchor of the chunk, each
pair in a task of its own that holds one chunk and one block. What leaves a task is at most the wanted
number of rows per anchor and window. So no group grows with the data, and rows that repeat or a label that
holds most rows only make more blocks. Where vectors spread evenly over many dimensions the bounds are wide, and nearly all
blocks are read: the work is then queries times rows. Nothing is capped, and results are exact.

Defined cases: rows with a null label or vector, or a null or non-finite component take no part; vectors meet only
those of the same number of components. Ids have to be of an integer type (else TypeError); null ids come last
among equal scores, then repeated rows in an order of their own. Each row is a row: one that repeats an anchor's id
may be its positive, and repeated anchors each get their results. Sums have to fit into 64 bits. Extra columns are
left out. An empty table, or one without anchors, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Rows of a block, anchors of a chunk, zone maps of a group, and blocks of a group that are read first.
BLOCK, CHUNK, ZONES, FIRST = 1024, 256, 1024, 2
#: Bits per dimension of a place on the curve.
LEVELS = 4
#: Products and sums below this are exact in doubles.
_EXACT = float(1 << 53)

_BLOCK = "size int, block long, rows array<long>, keys array<long>, labels array<long>, matrix binary, low array<long>, high array<long>, low_label long, high_label long"
_FOUND = "anchor long, chunk long, slot int, row long, key long, score long"


def hilbert(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**levels, as big-endian bytes.

    The coordinates are transposed bit by bit by exchanges and inversions of the lower bits (Skilling 2004), all points at once.
    """
    n, size = cells.shape
    if not size:
        return np.zeros((n, 1), np.uint8)
    x = cells.astype(np.uint32).copy()
    bit = np.uint32(1 << (levels - 1))
    while bit > 1:
        lower = np.uint32(bit - 1)
        for d in range(size):
            up = (x[:, d] & bit) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, d]) & lower).astype(np.uint32)
            x[:, 0] ^= np.where(up, lower, swap)
            x[:, d] ^= swap
        bit >>= np.uint32(1)
    for d in range(1, size):
        x[:, d] ^= x[:, d - 1]
    flip, bit = np.zeros(n, np.uint32), np.uint32(1 << (levels - 1))
    while bit > 1:
        flip ^= np.where(x[:, -1] & bit, bit - np.uint32(1), 0).astype(np.uint32)
        bit >>= np.uint32(1)
    x ^= flip[:, None]
    order = np.arange(levels - 1, -1, -1, dtype=np.uint32)
    bits = ((x[:, None, :] >> order[None, :, None]) & 1).astype(np.uint8)  # the highest bits of all dimensions first
    return np.packbits(bits.reshape(n, -1), axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of whole numbers, exactly; in doubles where all sums fit."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible scores of each anchor with the rows inside each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low.T) + products(down, high.T), products(up, high.T) + products(down, low.T)


def usable(rows: DataFrame, asked: Column, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """Rows that take part: row, key, label, asked, size, q (whole components)."""
    kind = rows.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids have to be of an integer type: {key} is {kind.simpleString()}")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = rows.select(
        F.col(key).cast("long").alias("key"), label.cast("long").alias("label"),
        F.coalesce(asked, F.lit(False)).alias("asked"), F.col(vector).cast("array<double>").alias("v"),
    )
    return plain.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), "key", "label", "asked", F.size("v").alias("size"),
        F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("q"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, the place on the Hilbert curve of their number of components."""
    stats: dict[int, list[tuple[float, float, int]]] = {}
    summed = rows.select("size", F.posexplode("q")).groupBy("size", "pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"))
    for r in summed.orderBy("size", "pos").collect():  # a line per component: the width of the vectors, not their number
        stats.setdefault(r["size"], []).append((r["m"], r["s"] or 0.0, r["pos"]))

    @F.arrow_udf("binary")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = batch.value_lengths().to_numpy()
            out: list[bytes] = [b""] * len(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                points = batch.take(pa.array(at)).flatten().to_numpy().reshape(-1, size).astype(float)
                mean, spread, pos = (np.array(x) for x in zip(*stats[size], strict=True))
                unit = (points - mean) / np.maximum(spread, 1e-9) / 4 + 0.5  # two deviations either way
                cells = np.clip(np.floor(unit * (1 << LEVELS)), 0, (1 << LEVELS) - 1)
                found = hilbert(cells[:, np.lexsort((pos, -spread))])
                for i, own in zip(at, found, strict=True):
                    out[i] = own.tobytes()
            yield pa.array(out, pa.binary())

    return rows.withColumn("place", place("q"))


def blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``rows`` in blocks of at most ``most``, by size, label and place; a written table with a row per block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            size = table["size"][0].as_py()
            q = table["q"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, size)
            labels = table["label"].to_numpy()
            lists = {"rows": table["row"], "keys": table["key"], "labels": table["label"]}
            made = {n: pa.array([c.to_pylist()], pa.list_(pa.int64())) for n, c in lists.items()}
            edges = {"low": q.min(axis=0), "high": q.max(axis=0)}
            return pa.RecordBatch.from_pydict(
                {
                    "size": pa.array([size], pa.int32()), "block": pa.array([number], pa.int64()), **made,
                    "matrix": pa.array([q.astype(np.int64).tobytes()], pa.binary()),
                    **{n: pa.array([x], pa.list_(pa.int64())) for n, x in edges.items()},
                    "low_label": pa.array([labels.min()]), "high_label": pa.array([labels.max()]),
                }
            )

        def full(end: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            while table.num_rows:
                sizes = table["size"].to_numpy()
                own = int(np.searchsorted(sizes, sizes[0], "right"))
                if own == len(sizes) and own < most and not end:
                    break
                yield block(table.slice(0, min(own, most)))
                table = table.slice(min(own, most))
            held[:] = table.to_batches()

        for batch in batches:
            held.append(batch)
            yield from full(False)
        if held:
            yield from full(True)

    order = ["size", "label", "place", F.xxhash64("row"), "row"]  # repeated vectors are spread by their row
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("size", "row", "key", "label", "q")
    return materialize(sorted_.mapInArrow(cut, _BLOCK), name)


def _lists(table: pa.Table, column: str, of=np.int64) -> np.ndarray:
    return np.array(table[column][0].as_py(), of)


def _matrix(table: pa.Table, size: int, n: int, column: str = "matrix") -> np.ndarray:
    stored = table[column][0].as_py()
    return np.frombuffer(stored, np.int64).reshape(n, size) if stored else np.zeros((n, size), np.int64)


def _empty(kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in kinds})


_FOUND_KINDS = [("anchor", pa.int64()), ("chunk", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("key", pa.int64()), ("score", pa.int64())]
_PICKED_KINDS = [("size", pa.int32()), ("chunk", pa.int64()), ("block", pa.int64()), ("wanted", pa.list_(pa.int32()))]


def _limits(table: pa.Table, rows: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest wanted scores per anchor and slot; a slot without a window wants nothing."""
    least = np.full((len(rows), slots), np.iinfo(np.int64).max)
    most = np.full((len(rows), slots), np.iinfo(np.int64).min)
    at = {row: i for i, row in enumerate(rows.tolist())}
    for limit in table["limits"][0].as_py() or []:
        least[at[limit["anchor"]], limit["slot"]], most[at[limit["anchor"]], limit["slot"]] = limit["least"], limit["most"]
    return least, most


def chosen(chunks: DataFrame, zones: DataFrame, slots: int, same: bool, first: bool) -> DataFrame:
    """(size, chunk, block, wanted): the blocks whose bounds meet a window of an anchor, and which anchors' (places in the chunk).

    ``same`` asks for blocks that hold the anchor's label, else for those that hold another. Of each group of zone maps the
    ``FIRST`` with the highest upper bounds of an anchor are taken if ``first``, else all others.
    """

    def pick(asked: pa.Table, offered: pa.Table) -> pa.Table:
        if not asked.num_rows or not offered.num_rows:
            return _empty(_PICKED_KINDS)
        size = asked["size"][0].as_py()
        rows, labels = _lists(asked, "rows"), _lists(asked, "labels")
        least, most = _limits(asked, rows, slots)
        order = np.argsort(offered["zone_block"].to_numpy())
        block = offered["zone_block"].to_numpy()[order]
        low, high = (np.array(offered[c].to_pylist(), np.int64).reshape(len(block), size)[order] for c in ("low", "high"))
        from_, to = offered["low_label"].to_numpy()[order], offered["high_label"].to_numpy()[order]
        down, up = bounds(_matrix(asked, size, len(rows)), low, high)
        holds = (from_ <= labels[:, None]) & (labels[:, None] <= to) if same else (from_ != labels[:, None]) | (to != labels[:, None])
        meets = np.zeros_like(holds)
        for s in range(slots):
            meets |= (up >= least[:, s, None]) & (down <= most[:, s, None])
        # The first choice has to be the same in both rounds, so it looks at labels and bounds alone.
        rank = np.argsort(np.argsort(np.where(holds, -up, np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1, kind="stable")
        take = holds & meets & ((rank < FIRST) if first else (rank >= FIRST))
        at = np.flatnonzero(take.any(axis=0))
        picked = [np.full(len(at), size, np.int32), np.full(len(at), asked["chunk"][0].as_py()), block[at], [np.flatnonzero(take[:, b]) for b in at]]
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(_PICKED_KINDS, picked, strict=True)})

    n_groups = -(-zones.count() // ZONES)
    group = F.pmod(F.xxhash64("block"), F.lit(max(1, n_groups)))
    right = zones.select(
        F.col("size").alias("zone_size"), group.cast("long").alias("zone_group"), F.col("block").alias("zone_block"), "low", "high", "low_label", "high_label"
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_groups - 1)).cast("long"))
    left = chunks.select("size", "chunk", F.explode(every).alias("part"), "rows", "labels", "matrix", "limits")
    each = right.groupBy("zone_size", "zone_group").agg(F.collect_list(F.struct("zone_block", "low", "high", "low_label", "high_label")).alias("zones"))
    # A group of zone maps is bounded, and goes to each chunk as one row.
    offers = left.join(each, (F.col("size") == F.col("zone_size")) & (F.col("part") == F.col("zone_group")))

    def of_group(table: pa.Table) -> pa.Table:
        own = table["zones"].combine_chunks().flatten()
        return pick(table, pa.Table.from_arrays(own.flatten(), names=[own.type.field(i).name for i in range(own.type.num_fields)]))

    kind = "size int, chunk long, block long, wanted array<int>"
    return offers.groupBy("size", "chunk", "part").applyInArrow(of_group, kind)


def met(picked: DataFrame, chunks: DataFrame, stored: DataFrame, slots: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of the chosen blocks per anchor and slot (and block): anchor, chunk, slot, row, key, score."""

    def meet(asked: pa.Table, offered: pa.Table) -> pa.Table:
        size = asked["size"][0].as_py()
        wanted = np.array(asked["wanted"][0].as_py())
        rows, labels = _lists(asked, "rows"), _lists(asked, "labels")
        least, most = _limits(asked, rows, slots)
        their_rows, their_labels = _lists(offered, "their_rows"), _lists(offered, "their_labels")
        keys = np.array(offered["their_keys"][0].as_py(), object)
        none = np.array([key is None for key in keys])
        known = np.where(none, 0, keys).astype(np.int64)
        tie = np.empty(len(keys), np.int64)
        tie[np.lexsort((their_rows, known, none))] = np.arange(len(keys))
        theirs = _matrix(offered, size, len(their_rows), "their_matrix")
        score = products(_matrix(asked, size, len(rows))[wanted], theirs.T)
        out: dict[str, list] = {n: [] for n, _ in _FOUND_KINDS}
        for i, a in enumerate(wanted.tolist()):
            fits = (their_labels == labels[a]) & (their_rows != rows[a]) if same else their_labels != labels[a]
            for s in range(slots):
                at = np.flatnonzero(fits & (score[i] >= least[a, s]) & (score[i] <= most[a, s]))
                at = at[np.lexsort((tie[at], -score[i, at]))[:k]]
                out["anchor"] += [rows[a]] * len(at)
                out["slot"] += [s] * len(at)
                out["row"] += their_rows[at].tolist()
                out["key"] += keys[at].tolist()
                out["score"] += score[i, at].tolist()
        out["chunk"] = [asked["chunk"][0].as_py()] * len(out["row"])
        return pa.table({n: pa.array(out[n], t) for n, t in _FOUND_KINDS})

    left = picked.join(chunks, ["size", "chunk"]).select("size", "chunk", "block", "wanted", "rows", "labels", "matrix", "limits")
    theirs = stored.select("size", "block", *[F.col(c).alias(f"their_{c}") for c in ("rows", "keys", "labels", "matrix")])
    right = picked.select("size", "chunk", "block").join(theirs, ["size", "block"]).select(
        F.col("size").alias("their_size"), F.col("chunk").alias("their_chunk"), F.col("block").alias("their_block"),
        "their_rows", "their_keys", "their_labels", "their_matrix",
    )
    together = left.groupBy("size", "chunk", "block").cogroup(right.groupBy("their_size", "their_chunk", "their_block"))
    return together.applyInArrow(meet, _FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per anchor and slot, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(chunks: DataFrame, limits: DataFrame, stored: DataFrame, slots: int, k: int, same: bool, name: str) -> DataFrame:
    """The ``k`` best rows inside each anchor's windows, in two rounds: anchor, chunk, slot, row, key, score, rank.

    ``limits`` has anchor, chunk, slot, least, most (both inclusive).
    """

    def limited(own: DataFrame) -> DataFrame:
        # At most CHUNK anchors and their slots.
        packed = own.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "slot", "least", "most")).alias("limits"))
        return materialize(chunks.join(packed, "chunk"), f"{name}-chunks")

    zones = stored.select("size", "block", "low", "high", "low_label", "high_label")
    asked = limited(limits)
    picked = materialize(chosen(asked, zones, slots, same, True), f"{name}-picked")
    one = materialize(best(met(picked, asked, stored, slots, k, same), k), f"{name}-found")
    # With ``k`` found, only what is as good as the last of them can still come in.
    floor = one.groupBy("anchor", "slot").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k)
    again = limited(
        limits.join(floor.select("anchor", "slot", "floor"), ["anchor", "slot"], "left").withColumn("least", F.greatest("least", F.coalesce("floor", "least")))
    )
    picked = materialize(chosen(again, zones, slots, same, False), f"{name}-picked")
    two = met(picked, again, stored, slots, k, same)
    return best(one.drop("rank").unionByName(two), k)


def mine(
    rows: DataFrame,
    asked: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    k: int = 5,
    low: int = 80,
    scale: int = 256,
) -> DataFrame:
    """Hard negatives of the first ``positives`` rows of the same label of each row for which ``asked`` holds.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each
    anchor and positive the first ``k`` rows of another label with a score from ``low`` hundredths of the
    positive's up to the positive's.
    """
    clean = materialize(placed(materialize(usable(rows, asked, key, vector, label, scale), "vectors")), "placed-vectors")
    stored = blocks(clean, BLOCK, "vector-blocks")
    chunks = blocks(clean.where("asked"), CHUNK, "anchor-chunks").withColumnRenamed("block", "chunk")
    every = chunks.select("chunk", F.explode(F.arrays_zip("rows", "keys")).alias("x")).select(
        "chunk", F.col("x.rows").alias("anchor"), F.col("x.keys").alias("anchor_id")
    )
    chunks = chunks.select("size", "chunk", "rows", "labels", "matrix")
    whole = np.iinfo(np.int64)
    open_ = every.select("anchor", "chunk", F.lit(0).alias("slot"), F.lit(int(whole.min)).alias("least"), F.lit(int(whole.max)).alias("most"))
    first = materialize(search(chunks, open_, stored, 1, positives, True, "positives"), "positives")
    pairs = first.select(
        "anchor", "chunk", (F.col("rank") - 1).cast("int").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # The whole numbers n with low * p <= 100 * n <= 100 * p; none below zero.
    least = F.expr(f"(positive_score * {low}L + IF(positive_score > 0, 99L, 0L)) div 100L")
    windows = pairs.select("anchor", "chunk", "slot", least.alias("least"), F.col("positive_score").alias("most")).where("least <= most")
    found = search(chunks, windows, stored, positives, k, False, "negatives")
    return (
        found.select("anchor", "slot", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs.drop("chunk"), ["anchor", "slot"])
        .join(every.drop("chunk"), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
