"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector, less the mean of all, is turned by a random rotation and kept as one bit per dimension with
two scalars: its length and its inner product with its own code. From a query's rotated vector and the
packed bits a table look-up per byte estimates the inner product; the scalars correct it and bound its
error. Only vectors whose bound can still beat the best found are compared on their original values.

Vectors fall into blocks of bounded size by hash, queries too; each block of vectors meets each block of
queries once, in a task of its own, and gives out the best of the block. So no row meets an unbounded
group, nothing is skewed by equal vectors, and nothing passes the driver but the mean vector. All rows
are indexed and every query sees all codes.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part.
Vectors meet only vectors of the same number of components. Equal distances go by the smaller id, null
ids last; equal rows count each for itself, and a query's own row is left out. With fewer candidates than
asked for, all are returned. Ids have to be of an integer type (else TypeError). Distances whose squares leave
the range of doubles are infinite, and go by id. An empty table gives an empty table. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Rows of a block of vectors, and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
LEAST_BLOCKS = 16
#: Width of the error bound in standard deviations, roughly.
BOUND = 2.5
SEED = 20240607


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every call."""
    matrix, upper = np.linalg.qr(np.random.default_rng(SEED + size).standard_normal((size, size)))
    return matrix * np.sign(np.diag(upper))


def codes(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, length, and inner product of each unit vector with its code."""
    rest = vectors - mean
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(length, 1e-300)[:, None]) @ turn.T
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(own > 0, own, 1.0)


def _flat(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def index(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Every vector that takes part, with its code (row, key, size, v, bits, length, own), and the means by size."""
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    clean = (
        rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.coalesce(usable, F.lit(False)))
        .where(F.exists("v", lambda x: x != 0))
        .withColumn("size", F.size("v"))
    )
    means: dict[int, dict[int, float]] = {}
    for r in clean.select("size", F.posexplode("v")).groupBy("size", "pos").agg(F.avg("col").alias("m")).collect():
        means.setdefault(r["size"], {})[r["pos"]] = r["m"]
    centres = {size: np.array([m[i] for i in range(size)]) for size, m in means.items()}

    @F.arrow_udf("struct<bits:binary,length:double,own:double>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.value_lengths().to_numpy()
            bits = [b""] * len(sizes)
            length, own = np.zeros(len(sizes)), np.ones(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size not in turns:
                    turns[size] = rotation(size)
                packed, length[at], own[at] = codes(_flat(batch.take(pa.array(at)), size), centres[size], turns[size])
                for i, row in zip(at, packed, strict=True):
                    bits[i] = row.tobytes()
            yield pa.StructArray.from_arrays(
                [pa.array(bits, pa.binary()), pa.array(length), pa.array(own)], ["bits", "length", "own"]
            )

    coded = clean.withColumn("row", F.monotonically_increasing_id()).withColumn("c", code("v"))
    return materialize(coded.select("row", "key", "size", "v", "c.*"), "vector-index"), centres


def best_of_block(vectors: pa.Table, queries: pa.Table, k: int, centre: np.ndarray) -> dict[str, list]:
    """Each query's ``k`` nearest of one block."""
    size = len(centre)
    out: dict[str, list] = {"query": [], "query_key": [], "row": [], "key": [], "score": []}
    plain, asked = _flat(vectors["v"], size), _flat(queries["q_v"], size)
    rows, keys = vectors["row"].to_numpy(), np.array(vectors["key"].to_pylist(), object)
    order = np.array([(key is None, 0 if key is None else key, row) for key, row in zip(keys, rows, strict=True)], dtype=[("n", "?"), ("k", "i8"), ("r", "i8")])
    place = np.empty(len(rows), np.int64)
    place[np.argsort(order)] = np.arange(len(rows))
    bits = np.frombuffer(b"".join(vectors["bits"].to_pylist()), np.uint8).reshape(len(rows), -1)
    length, own = vectors["length"].to_numpy(), vectors["own"].to_numpy()
    error = np.sqrt(np.maximum(1 - own**2, 0)) / own * BOUND / np.sqrt(max(size - 1, 1))
    rest = asked - centre
    reach = np.linalg.norm(rest, axis=1)
    turned = (rest / np.maximum(reach, 1e-300)[:, None]) @ rotation(size).T
    padded = np.zeros((len(turned), bits.shape[1] * 8))
    padded[:, :size] = turned
    patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    # Sum of a query's components where a byte's bits are set, for each byte of a code and its 256 values.
    tables = padded.reshape(len(turned), -1, 8) @ patterns.T
    every = np.arange(bits.shape[1])[:, None]
    query_rows, query_keys = queries["q_row"].to_numpy(), queries["q_key"].to_pylist()
    for q in range(len(asked)):
        other = rows != query_rows[q]
        dot = (2 * tables[q][every, bits.T].sum(axis=0) - turned[q].sum()) / np.sqrt(size) / own

        def squared(cosine: np.ndarray, q: int = q) -> np.ndarray:
            return length**2 + reach[q] ** 2 - 2 * length * reach[q] * np.clip(cosine, -1, 1)

        def exact(at: np.ndarray, q: int = q) -> np.ndarray:
            return np.sqrt(((plain[at] - asked[q]) ** 2).sum(axis=1))

        guess = np.where(other, squared(dot), np.inf)
        some = min(4 * k, int(other.sum()))
        if not some:
            continue
        first = np.argpartition(guess, some - 1)[:some]
        near = exact(first)
        limit = np.sort(near)[min(k, some) - 1] if some >= k else np.inf
        low = np.where(other, squared(dot + error), np.inf)
        at = np.flatnonzero(other & (low <= limit**2 * (1 + 1e-9) + 1e-12))
        at = np.union1d(at, first)
        score = exact(at)
        best = np.lexsort((place[at], score))[:k]
        out["query"] += [query_rows[q]] * len(best)
        out["query_key"] += [query_keys[q]] * len(best)
        out["row"] += rows[at[best]].tolist()
        out["key"] += keys[at[best]].tolist()
        out["score"] += score[best].tolist()
    return out


def nearest(rows: DataFrame, asked: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row for which ``asked`` (over ``key``) holds, by Euclidean distance.

    Returns query_id, rank (from 1), vec_id and score.
    """
    kind = rows.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids have to be of an integer type: {key} is {kind.simpleString()}")
    coded, centres = index(rows, key, vector)
    total = coded.count()
    wanted = coded.withColumn(key, F.col("key")).where(asked).drop(key)
    n_asked = wanted.count()
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK))
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    spread = F.pmod(F.xxhash64("row"), F.lit(blocks))
    left = coded.withColumn("block", spread).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = (
        wanted.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        # Columns of its own: both sides come from one table, and would lose those that the other does not need.
        .select(*[F.col(c).alias(f"q_{c}") for c in ("block", "part", "size", "row", "key", "v")])
    )
    schema = "query long, query_key long, row long, key long, score double"
    kinds = [("query", pa.int64()), ("query_key", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("score", pa.float64())]

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds})
        found = best_of_block(vectors, queries, k, centres[vectors["size"][0].as_py()])
        return pa.table({n: pa.array(found[n], t) for n, t in kinds})

    pairs = left.groupBy("size", "block", "part").cogroup(right.groupBy("q_size", "q_block", "q_part")).applyInArrow(meet, schema)
    order = Window.partitionBy("query").orderBy("score", F.col("key").asc_nulls_last(), "row")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("query_key").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")
    )
