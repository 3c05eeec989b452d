"""Near-duplicate groups by SimHash, found with a Gray-order hierarchical index.

A document's fingerprint has 64 bits: each is set if it is set in over half of the hashes of the document's
runs of three lower-cased words, repeats included. Distinct fingerprints are the nodes; two are linked if
they differ in ``BITS`` bits at most.

Two such fingerprints agree in one of ``BITS + 1`` equal parts of their bits. So each fingerprint goes into
as many tables, turned so that another part leads in each; what is sought in a table are fingerprints with
equal leading parts. A table is sorted by the Gray rank of its codes, in which neighbours differ in few bits and equal
leading parts lie together, and cut into blocks of bounded size. A block carries the bits that all its codes
share (a mask and a value). Blocks meet themselves and those others that hold the same leading part, unless
the shared bits of both already differ in more than ``BITS`` places.

Inside a block the index goes on: groups of ``FAN`` neighbours, groups of groups, up to one root. Each node holds
only the shared bits that the nodes above it do not hold yet, so a search from the root adds up
differences on its way down and leaves out whole groups as soon as there are too many. At a single code
the sum is the Hamming distance, so what is found is exact. Nothing is missed and no bucket is capped.

The links of a pair of blocks are reduced to a spanning forest before they leave the task. Components are
found by alternating star steps over written tables. A block is a row of its codes, so tasks hold two blocks; a
leading part that holds very many fingerprints is many blocks.

Defined cases: a text that is null or has no word has the fingerprint zero, linked like any other. One with
fewer than three words has one run, all of it. Null ids come last: a group's id is its smallest id, and
null if it has none but null ones. Repeated rows each get their group. Extra columns of the input are left
out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .near_dedup import components

RUN = 3
SEED = 42
#: Most bits in which linked fingerprints differ.
BITS = 3
TABLES = BITS + 1
LEAD = 64 // TABLES
#: Codes of a block, and children of a node.
BLOCK, FAN = 8192, 16
#: Places of a search that are looked at in one go.
FRONTIER = 1 << 20
#: Words that are hashed in one go.
_PART = 1 << 16
_SPACES = b" \t\n\x0b\x0c\r"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    at, size = 0, 1 << 20
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes) -> int:
    """The SimHash of a UTF-8 text."""
    counts, total, before = np.zeros(64, np.int64), 0, []
    for piece in _pieces(data.lower()):  # of bytes, so that only A to Z change
        for at in range(0, len(piece), _PART):
            words = before + piece[at : at + _PART]
            if len(words) < RUN:
                before = words
                continue
            text, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            runs = zip(starts[: len(words) - RUN + 1].tolist(), ends[RUN - 1 :].tolist(), strict=True)
            made = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in runs], ">u8")
            counts += np.unpackbits(made.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(made)
            before = words[len(words) - RUN + 1 :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * counts > total).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text``, as a long that holds the 64 bits."""

    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint(value.as_py() or b"") for value in batch], np.uint64)
            yield pa.array(found.view(np.int64), pa.int64())

    return docs.withColumn(into, made(F.col(text).cast("binary")))


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray order, as a long that sorts like the unsigned number."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def shared(mask: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and value of the bits that the nodes of each group from ``starts`` on have in common."""
    sizes = np.diff(np.append(starts, len(value)))
    unlike = np.bitwise_or.reduceat(value ^ np.repeat(value[starts], sizes), starts)
    both = np.bitwise_and.reduceat(mask, starts) & ~unlike
    return both, value[starts] & both


class Index:
    """A hierarchy over codes in Gray order; levels from the root down to the codes."""

    def __init__(self, codes: np.ndarray) -> None:
        level = [(np.full(len(codes), ~np.uint64(0)), codes)]
        while len(level[-1][1]) > 1:
            mask, value = level[-1]
            level.append(shared(mask, value, np.arange(0, len(value), FAN)))
        level.reverse()
        self.value = [value for _, value in level]
        # What the node above holds is not compared again.
        self.mask = [level[0][0]] + [
            mask & ~np.repeat(above, FAN)[: len(mask)] for (above, _), (mask, _) in zip(level, level[1:], strict=False)
        ]

    def search(self, asked: np.ndarray, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``asked``, place in the codes) with equal ``lead`` first bits and at most ``BITS`` differences."""
        part = max(1, FRONTIER // FAN)
        todo = [
            (0, np.arange(at, min(at + part, len(asked))), None, None) for at in range(0, len(asked), part)
        ]
        while todo:
            depth, query, node, seen = todo.pop()
            if node is None:
                node, seen = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
            unlike = (asked[query] ^ self.value[depth][node]) & self.mask[depth][node]
            seen = seen + np.bitwise_count(unlike)
            keep = (seen <= BITS) & (unlike >> np.uint64(64 - lead) == 0)
            query, node, seen = query[keep], node[keep], seen[keep]
            if not len(query):
                continue
            if depth + 1 == len(self.value):
                yield query, node
                continue
            below = len(self.value[depth + 1])
            for at in range(0, len(query), part):
                own = slice(at, at + part)
                child = (node[own, None] * FAN + np.arange(FAN)).ravel()
                there = child < below
                todo.append((depth + 1, np.repeat(query[own], FAN)[there], child[there], np.repeat(seen[own], FAN)[there]))


def forest(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each one's group, for numbers 0..size-1 joined by ``pairs``."""
    root = np.arange(size)
    for a, b in pairs:
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            root[high[apart]] = low[apart]  # one of several wins; the others meet in the next turn
            while (root[root] != root).any():
                root = root[root]
    return root


def links(nodes: DataFrame, code: str = "fingerprint") -> DataFrame:
    """Edges (a, b) between the distinct codes of ``nodes`` that connect all that are linked."""
    turned = [
        F.struct(
            F.lit(t).alias("table"),
            (F.shiftleft(code, t * LEAD).bitwiseOR(F.shiftrightunsigned(code, 64 - t * LEAD)) if t else F.col(code)).alias("code"),
        )
        for t in range(TABLES)
    ]
    tables = nodes.select(F.explode(F.array(*turned)).alias("x")).select("x.*", gray_rank(F.col("x.code")).alias("place"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a sorted partition."""
        number = TaskContext.get().partitionId() << 32
        held: dict[str, np.ndarray] = {"table": np.empty(0, np.int32), "code": np.empty(0, np.int64)}

        def block(table: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            codes = code.view(np.uint64)
            mask, value = shared(np.full(len(codes), ~np.uint64(0)), codes, np.zeros(1, np.int64))
            leads = (codes[[0, -1]] >> np.uint64(64 - LEAD)).astype(np.int64)
            return pa.RecordBatch.from_pydict(
                {
                    "table": pa.array(table[:1], pa.int32()), "block": pa.array([number], pa.int64()),
                    "codes": pa.array([codes.tobytes()], pa.binary()), "first": pa.array(leads[:1]), "last": pa.array(leads[1:]),
                    "mask": pa.array(mask.view(np.int64)), "value": pa.array(value.view(np.int64)),
                }
            )

        def blocks(end: bool) -> Iterator[pa.RecordBatch]:
            table, code = held["table"], held["code"]
            while len(code):
                own = int(np.searchsorted(table, table[0], "right"))
                if own == len(code) and own < BLOCK and not end:
                    break
                size = min(own, BLOCK)
                yield block(table[:size], code[:size])
                table, code = table[size:], code[size:]
            held["table"], held["code"] = table, code

        for batch in batches:
            for name in held:
                held[name] = np.concatenate([held[name], batch.column(name).to_numpy()])
            yield from blocks(False)
        yield from blocks(True)

    sorted_ = tables.repartitionByRange("table", "place").sortWithinPartitions("table", "place").select("table", "code")
    kind = "table int, block long, codes binary, first long, last long, mask long, value long"
    made = materialize(sorted_.mapInArrow(cut, kind), "gray-blocks")
    patterns = made.select("table", "block", "mask", "value", F.explode(F.array_distinct(F.array("first", "last"))).alias("lead"))
    left, right = (patterns.select("table", "lead", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "mask", "value")]) for x in "ab")
    unlike = F.bit_count(F.col("value_a").bitwiseXOR(F.col("value_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b")))
    others = left.join(right, ["table", "lead"]).where((F.col("block_a") < F.col("block_b")) & (unlike <= BITS))
    pairs = (
        others.select("table", F.col("block_a").alias("a"), F.col("block_b").alias("b"))
        .distinct()
        .union(made.select("table", F.col("block").alias("a"), F.col("block").alias("b")))
    )

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        mine = np.frombuffer(one["codes"][0].as_py(), np.uint64)
        theirs = np.frombuffer(other["right_codes"][0].as_py(), np.uint64)
        same = one["a"][0].as_py() == one["b"][0].as_py()
        codes = mine if same else np.concatenate([mine, theirs])
        shift = 0 if same else len(mine)
        found = ((q, n + shift) for q, n in Index(theirs).search(mine, LEAD))
        root = forest(len(codes), ((a[a < b], b[a < b]) for a, b in found))
        at = np.flatnonzero(root != np.arange(len(root)))
        turn = np.uint64(one["table"][0].as_py() * LEAD)
        back = codes if not turn else (codes >> turn) | (codes << (np.uint64(64) - turn))
        return pa.table({"a": pa.array(back[at].view(np.int64)), "b": pa.array(back[root[at]].view(np.int64))})

    keys = ["table", "a", "b"]
    left_side = pairs.join(made.select("table", F.col("block").alias("a"), "codes"), ["table", "a"]).select(*keys, "codes")
    # Both sides come from one table; the right one has names, and so columns, of its own.
    right_side = pairs.join(made.select("table", F.col("block").alias("b"), "codes"), ["table", "b"]).select(
        *[F.col(c).alias(f"right_{c}") for c in (*keys, "codes")]
    )
    together = left_side.groupBy(*keys).cogroup(right_side.groupBy(*[f"right_{c}" for c in keys]))
    return together.applyInArrow(meet, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: key, fingerprint (16 hexadecimal digits), component_id."""
    signed = materialize(
        fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text").select("key", "fingerprint"),
        "fingerprints",
    )
    nodes = materialize(signed.groupBy("fingerprint").agg(F.min("key").alias("least")), "fingerprint-nodes")
    joined = components(links(nodes))
    rooted = nodes.join(joined, nodes["fingerprint"] == joined["id"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fingerprint", "component_id")
    return signed.join(named, "fingerprint").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
