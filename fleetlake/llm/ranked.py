"""Ranked lexical search by sparse ball trees, exact.

A document is a sparse vector of whole numbers, one per term: ``(10**9 * tf) div (1000 * tf + 8 * m)``, where
m grows with its length. A query is a vector of term weights, and a score their inner product. Only terms
of some query matter to a score, so documents are kept in those dimensions alone; counts of documents and of all terms cover
everything.

Documents are sorted by their heaviest term and cut into blocks of bounded size. Each block is a ball tree: its
documents are split at the median between two that lie far apart, down to leaves of ``LEAF``. A node has a
centre of whole numbers (the mean, rounded down, which stays sparse) and a radius that reaches all its documents. No score in
it exceeds the centre's score plus the radius times the query's length; both lengths are rounded up by far
more than doubles can err, so a bound is never below a true score. A query goes through a tree best-first: the node with the
highest bound is opened next, until no bound reaches the score that is to beat. Leaves are scored in
64-bit integers.

Two rounds save most trees the search: each query is answered in the block with the highest bound first; the score of its
last place there is the one to beat everywhere else. Blocks none of whose bounds reach it are not searched.

Queries are taken in portions of about ``TERMS`` terms; the driver holds the terms of one portion, with a weight
each, and a score to beat per query. Each portion reads the documents once. Documents move once, as vectors; what
leaves a task is at most ``k`` documents per block and query.

Defined cases: a null text has no term, and a document without a term never counts. A query without terms gets no
rows. Ids of documents have to be of an integer type (else TypeError); null ids come last among equal scores. Repeated rows count each
for itself, repeated queries too. Scores that are zero are left out. Extra columns are left out. No documents, or no
queries, give an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Terms of a portion of queries, on average.
TERMS = 1 << 18
#: Documents and vector entries of a block, and documents of a leaf.
BLOCK, ENTRIES, LEAF = 1024, 1 << 20, 32
#: Relative margin of a bound.
SAFE = 1e-9
_PIECE = 1 << 20
#: Bytes of ASCII that belong to no term become spaces, A to Z become a to z.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def term_counts(data: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text, taken in pieces that end between terms."""
    counts, at = Counter(), 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and _FOLD[data[end]] != 32:
            end += 1
        counts.update(data[at:end].translate(_FOLD).split())
        at = end
    return counts


def asked_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Queries as row, key and distinct terms; a written table."""

    @F.arrow_udf("array<binary>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted(term_counts(value.as_py() or b"")) for value in batch], pa.list_(pa.binary()))

    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col(key).alias("item"), found(F.col(text).cast("binary")).alias("terms"))
    return materialize(rows, "queries")


def sparse(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents as row, key, n (all terms), terms and counts (of the vocabulary); a written table."""

    @F.arrow_udf("struct<n:bigint,terms:array<int>,counts:array<int>>")
    def vector(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, terms, counts = [], [], []
            for value in batch:
                found = term_counts(value.as_py() or b"")
                n.append(found.total())
                own = sorted((vocabulary[t], c) for t, c in found.items() if t in vocabulary)
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            kind = pa.list_(pa.int32())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(terms, kind), pa.array(counts, kind)], ["n", "terms", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), vector(F.col(text).cast("binary")).alias("v"))
    return materialize(rows.select("row", "key", "v.*").where("n > 0"), "term-vectors")


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Rows:
    """Sparse rows: for row i the entries from ``starts[i]`` up to ``starts[i + 1]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        self.starts, self.columns, self.values = starts, columns, values

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(starts, self.columns[at], self.values[at])

    def part(self, low: int, high: int) -> Rows:
        own = slice(self.starts[low], self.starts[high])
        return Rows(self.starts[low : high + 1] - self.starts[low], self.columns[own], self.values[own])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Inner product of each row with ``dense``."""
        sums = np.concatenate([[0], np.cumsum(self.values * dense[self.columns])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width, np.int64)
        own = slice(self.starts[row], self.starts[row + 1])
        out[self.columns[own]] = self.values[own]
        return out

    def squares(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.values * self.values)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


class Tree:
    """A ball tree over the rows of a block; node 0 is the root."""

    FIELDS = ("terms", "starts", "columns", "values", "low", "high", "left", "right", "radius", "c_starts", "c_columns", "c_values")

    def __init__(self, **parts: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, parts[name])
        self.rows = Rows(self.starts, self.columns, self.values)
        self.centres = Rows(self.c_starts, self.c_columns, self.c_values)

    @classmethod
    def build(cls, given: Rows) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of the rows in it."""
        terms, columns = np.unique(given.columns, return_inverse=True)
        rows = Rows(given.starts, columns.astype(np.int64), given.values.astype(np.int64))
        order = np.arange(len(rows.starts) - 1)
        squares = rows.squares()
        nodes: list[list[int]] = []  # low, high, left, right
        todo = [(0, len(order), -1, 2)]
        while todo:
            low, high, above, side = todo.pop()
            if above >= 0:
                nodes[above][side] = len(nodes)
            nodes.append([low, high, -1, -1])
            if high - low <= LEAF:
                continue
            own = order[low:high]
            part = rows.take(own)

            def away(i: int, part: Rows = part, own: np.ndarray = own) -> np.ndarray:
                return squares[own] - 2 * part.dot(part.dense(i, len(terms))) + squares[own[i]]

            one = int(away(int(squares[own].argmax())).argmax())
            from_one = away(one)
            order[low:high] = own[np.argsort(from_one - away(int(from_one.argmax())), kind="stable")]
            middle = (low + high) // 2
            todo += [(middle, high, len(nodes) - 1, 3), (low, middle, len(nodes) - 1, 2)]
        rows = rows.take(order)
        squares = squares[order]
        radius, starts, c_columns, c_values = [], [0], [], []
        for low, high, _, _ in nodes:
            own = rows.part(low, high)
            sums = np.bincount(own.columns, own.values, len(terms))  # far below 2**53
            centre = (sums // (high - low)).astype(np.int64)
            reach = int((squares[low:high] - 2 * own.dot(centre) + (centre * centre).sum()).max())
            radius.append(math.isqrt(max(reach, 0)) + 1)
            at = np.flatnonzero(centre)
            c_columns.append(at)
            c_values.append(centre[at])
            starts.append(starts[-1] + len(at))
        shape = np.array(nodes, np.int64).reshape(-1, 4)
        return cls(
            terms=terms.astype(np.int64), starts=rows.starts, columns=rows.columns, values=rows.values,
            low=shape[:, 0], high=shape[:, 1], left=shape[:, 2], right=shape[:, 3], radius=np.array(radius, np.int64),
            c_starts=np.array(starts, np.int64), c_columns=np.concatenate(c_columns).astype(np.int64), c_values=np.concatenate(c_values).astype(np.int64),
        ), order

    def ask(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A query in the tree's own dimensions."""
        dense = np.zeros(len(self.terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        dense[at[here]] = weights[here]
        return dense

    def bounds(self, query: np.ndarray, upto: int | None = None) -> np.ndarray:
        """For each node a number that no score in it exceeds."""
        centres = self.centres if upto is None else self.centres.part(0, upto)
        length = math.sqrt(float((query.astype(np.float64) ** 2).sum())) * (1 + SAFE)
        return centres.dot(query) + np.ceil(self.radius[: len(centres.starts) - 1] * length * (1 + SAFE)).astype(np.int64) + 1

    def search(self, query: np.ndarray, k: int, beat: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, leaves scored): up to ``k`` rows that reach ``beat`` and are above 0, by score, then ``tie``."""
        bound = self.bounds(query)
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        beat, leaves, heap = max(beat, 1), 0, [(-int(bound[0]), 0)]
        while heap and -heap[0][0] >= beat:
            _, node = heapq.heappop(heap)
            if self.left[node] >= 0:
                for child in (int(self.left[node]), int(self.right[node])):
                    if bound[child] >= beat:
                        heapq.heappush(heap, (-int(bound[child]), child))
                continue
            leaves += 1
            low, high = int(self.low[node]), int(self.high[node])
            own = self.rows.part(low, high).dot(query)
            at = np.flatnonzero(own >= beat)
            if len(at):
                places, scores = np.concatenate([places, at + low]), np.concatenate([scores, own[at]])
                first = np.lexsort((tie[places], -scores))[:k]
                places, scores = places[first], scores[first]
                if len(scores) == k:
                    beat = max(beat, int(scores[-1]))
        return places, scores, leaves


_KIND = "block long, keys array<long>, ids array<long>, bounds array<long>, " + ", ".join(f"{n} binary" for n in Tree.FIELDS)
_FOUND = [("query", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("score", pa.int64())]


class Queries:
    """The queries of a portion: number, terms and weights of each."""

    def __init__(self, numbers: list[int], terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.numbers, self.terms, self.weights = numbers, terms, weights


def blocks(vectors: DataFrame, n: int, length: int, weights: np.ndarray, queries: Queries) -> DataFrame:
    """Trees over blocks of documents, with each query's bound on the whole block; a written table."""

    @F.arrow_udf("struct<lead:int,values:array<int>>")
    def scaled(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for terms, counts, m in batches:
            starts, flat = terms.offsets.to_numpy(), terms.flatten().to_numpy()
            tf = counts.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(starts)
            value = 10**9 * tf // (1000 * tf + 8 * np.repeat(m.to_numpy(), sizes))
            heavy, lead = value * weights[flat], np.empty(len(sizes), np.int32)
            for i, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True)):
                lead[i] = flat[a + int(heavy[a:b].argmax())] if b > a else -1
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.StructArray.from_arrays([pa.array(lead), pa.ListArray.from_arrays(offsets, pa.array(value, pa.int32()))], ["lead", "values"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int | None, np.ndarray, np.ndarray]] = []
        entries = 0

        def block() -> pa.RecordBatch:
            nonlocal number, entries
            number += 1
            sizes = np.array([len(x[2]) for x in held])
            flat = [np.concatenate([x[i] for x in held]) for i in (2, 3)]
            tree, order = Tree.build(Rows(np.concatenate([[0], np.cumsum(sizes)]), *flat))
            top = [int(tree.bounds(tree.ask(t, w), 1)[0]) for t, w in zip(queries.terms, queries.weights, strict=True)]
            longs = pa.list_(pa.int64())
            columns = {
                "block": pa.array([number], pa.int64()), "keys": pa.array([[held[i][1] for i in order]], longs),
                "ids": pa.array([[held[i][0] for i in order]], longs), "bounds": pa.array([top], longs),
                **{n: pa.array([getattr(tree, n).astype(np.int64).tobytes()], pa.binary()) for n in Tree.FIELDS},
            }
            held.clear()
            entries = 0
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            plain = [batch.column(c) for c in ("row", "key", "terms", "values")]
            for i in range(batch.num_rows):
                row, key = plain[0][i].as_py(), plain[1][i].as_py()
                # Copies, so that what is held of a batch is what is needed of it.
                terms, values = (c[i].values.to_numpy().astype(np.int64) for c in plain[2:])
                if held and (len(held) == BLOCK or entries + len(terms) > ENTRIES):
                    yield block()
                held.append((row, key, terms, values))
                entries += len(terms)
        if held:
            yield block()

    m = F.expr(f"10L + (90L * n * {n}L) div {length}L")
    given = vectors.where(F.size("terms") > 0).withColumn("x", scaled("terms", "counts", m))
    sorted_ = (
        given.select("row", "key", "terms", "x.values", "x.lead")
        .repartitionByRange("lead", F.xxhash64("row"))
        .sortWithinPartitions("lead", F.xxhash64("row"))
        .select("row", "key", "terms", "values")
    )
    return materialize(sorted_.mapInArrow(grow, _KIND), "ball-trees")


def answered(stored: DataFrame, queries: Queries, k: int, beat: np.ndarray, wanted: dict[int, int], first: bool) -> DataFrame:
    """The ``k`` best of each block per query: query, row, key, score.

    ``wanted`` names the block in which a query is answered first; the second round takes all other blocks.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line = {n: batch.column(n)[i].as_py() for n in ("block", "keys", "ids", "bounds")}
                open_ = [
                    q for q, bound in enumerate(line["bounds"]) if (wanted.get(q) == line["block"]) == first and bound >= max(beat[q], 1)
                ]
                if not open_:
                    continue
                tree = Tree(**{n: np.frombuffer(batch.column(n)[i].as_py(), np.int64) for n in Tree.FIELDS})
                ids, keys = np.array(line["ids"], np.int64), np.array(line["keys"], object)
                none = np.array([key is None for key in keys])
                tie = np.empty(len(keys), np.int64)
                tie[np.lexsort((ids, np.where(none, 0, keys).astype(np.int64), none))] = np.arange(len(keys))
                out: dict[str, list] = {n: [] for n, _ in _FOUND}
                for q in open_:
                    places, scores, _ = tree.search(tree.ask(queries.terms[q], queries.weights[q]), k, int(beat[q]), tie)
                    out["query"] += [queries.numbers[q]] * len(places)
                    out["row"] += ids[places].tolist()
                    out["key"] += keys[places].tolist()
                    out["score"] += scores.tolist()
                yield pa.RecordBatch.from_pydict({n: pa.array(out[n], t) for n, t in _FOUND})

    return stored.mapInArrow(search, "query long, row long, key long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def portion(docs: DataFrame, key: str, text: str, asked: DataFrame, k: int) -> DataFrame | None:
    """The results of some queries: query, row, key, score, rank."""
    given = asked.select("query", "terms").where(F.size("terms") > 0).orderBy("query").collect()  # about TERMS terms in all
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in given for t in r["terms"]}))}
    if not vocabulary:
        return None
    vectors = sparse(docs, key, text, vocabulary)
    n, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return None
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most the vocabulary
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counted:
        weights[r["term"]] = weight(n, r["count"])
    terms = [np.array(sorted(vocabulary[bytes(t)] for t in r["terms"]), np.int64) for r in given]
    queries = Queries([r["query"] for r in given], terms, [weights[t] for t in terms])
    stored = blocks(vectors, n, length, weights, queries)
    tops = stored.select("block", F.posexplode("bounds").alias("q", "bound")).groupBy("q").agg(F.max(F.struct("bound", "block")).alias("top"))
    wanted = {r["q"]: r["top"]["block"] for r in tops.collect()}  # a block per query of the portion
    start = np.zeros(len(given), np.int64)
    picked = stored.join(tops.select(F.col("top.block").alias("block")).distinct(), "block", "left_semi")
    one = materialize(best(answered(picked, queries, k, start, wanted, True), k), "first-answers")
    number = {q: i for i, q in enumerate(queries.numbers)}
    beat = start.copy()
    for r in one.where(F.col("rank") == k).select("query", "score").collect():  # a score per query
        beat[number[r["query"]]] = r["score"]
    reach = F.exists(F.zip_with("bounds", F.lit(np.maximum(beat, 1).tolist()), lambda b, s: b >= s), lambda x: x)
    two = answered(stored.where(reach), queries, k, beat, wanted, False)
    return best(one.drop("rank").unionByName(two), k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text"
) -> DataFrame:
    """The ``k`` documents with the highest scores for each row of ``items``: item, rank (from 1), key, score."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids have to be of an integer type: {key} is {kind.simpleString()}")
    queries = asked_terms(items, item, asked)
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    portions = max(1, -(-total // TERMS))
    # Each portion is answered on its own; their number follows the queries, not the documents.
    made = [portion(docs, key, text, queries.where(F.pmod(F.xxhash64("query"), F.lit(portions)) == p), k) for p in range(portions)]
    results = [x for x in made if x is not None]
    if not results:
        return docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField(item, items.schema[item].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(key, T.LongType()), T.StructField("score", T.LongType()),
        ]))
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole.join(queries.select("query", "item"), "query").select(
        F.col("item").alias(item), "rank", F.col("key").alias(key), "score"
    )
