"""Byte-level BPE encoding and decoding by given ranks.

A segment tree over the byte positions of a piece holds, at each node, the least rank of the pairs
that start below it. The root tells the next merge, and going left while the left child has that rank
finds its leftmost place. A merge changes the pairs of two live neighbours and empties a third leaf:
three point updates of logarithmic cost, so a piece of any length takes n log n steps.

Words repeat, so each task keeps a bounded table of those it has encoded: a space between two other
characters always starts a piece, so what lies between such spaces is encoded alike wherever it stands.
New pieces are merged together, their trees being rows of one array. There is no shuffle, and a task
holds one Arrow batch.

Defined cases: a null text is an empty one and has no ids; null ids decode to no bytes. Rows that
repeat are encoded each for itself. Extra columns are kept; a column with the result's name is
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers at most before it starts anew, and the longest it remembers.
REMEMBERED, REMEMBERED_LENGTH = 1 << 17, 64
#: Pieces of up to two to this power bytes, and one, are merged together; longer ones one by one.
TOGETHER_BITS = 6
#: Letters of text that are encoded together.
PORTION = 1 << 19
#: Leaves of all trees that take their steps together, at most.
LEAVES = 1 << 18
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the whole piece if it is a token, else least rank first, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], NONE)
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(position: int, rank: int) -> None:
        node = size + position
        tree[node] = rank
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    after = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n))  # where the token ahead of this one starts
    while (least := tree[1]) != NONE:
        node = 1
        while node < size:
            node *= 2
            if tree[node] != least:
                node += 1
        i = node - size
        j = after[i]
        end = after[j]
        after[i] = end
        before[end] = i
        if j < n - 1:
            put(j, NONE)
        put(i, ranks.get(piece[i : after[end]], NONE) if end < n else NONE)
        if i:
            p = before[i]
            put(p, ranks.get(piece[p:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Ranks:
    """Ranks in the forms the merges need: by bytes, by pair of bytes, and by pair of ids.

    A pair of tokens may merge if its bytes together are a token, so every split of a token into two
    tokens is a pair with that token's rank.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.of = ranks
        self.single = np.zeros(256, np.int64)
        self.two = np.full(1 << 16, NONE, np.int64)
        self.width = max(ranks.values(), default=0) + 1
        pairs = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            elif len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.values = np.array([pairs.get(k, NONE) for k in self.keys.tolist()], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_many(pieces: list[bytes], ranks: Ranks, size: int) -> list[bytes]:
    """The ids, as 32-bit numbers, of pieces of 2 to ``size`` + 1 bytes: one tree of ``size`` leaves each.

    The trees are the rows of one array and take their steps together; a step is the same search and
    the same three point updates as in ``merge``.
    """
    count, levels = len(pieces), size.bit_length() - 1
    lengths = np.array([len(p) for p in pieces])
    column = np.arange(size + 1)
    inside = column < lengths[:, None]
    text = np.zeros((count, size + 1), np.int64)
    text[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    tree = np.full((count, 2 * size), NONE, np.int64)
    tree[:, size:] = np.where(column[1:] < lengths[:, None], ranks.two[text[:, :-1] << 8 | text[:, 1:]], NONE)
    for node in range(size - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    token = ranks.single[text]
    after = np.tile(np.arange(1, size + 3), (count, 1))
    before = np.tile(np.arange(-1, size + 1), (count, 1))
    nodes = tree.ravel()

    def put(rows: np.ndarray, leaf: np.ndarray, rank) -> None:
        base, node = rows * (2 * size), leaf + size
        nodes[base + node] = rank
        for _ in range(levels):
            node = node >> 1
            nodes[base + node] = np.minimum(nodes[base + 2 * node], nodes[base + 2 * node + 1])

    rows = np.arange(count)
    while True:
        least = tree[rows, 1]
        going = least != NONE
        rows, least = rows[going], least[going]
        if not len(rows):
            break
        node = np.ones(len(rows), np.int64)
        for _ in range(levels):
            node = 2 * node
            node += nodes[rows * (2 * size) + node] != least
        i = node - size
        j = after[rows, i]
        end = after[rows, j]
        token[rows, i] = least
        inside[rows, j] = False
        after[rows, i] = end
        before[rows, end] = i
        more = end < lengths[rows]
        put(rows[more], j[more], NONE)
        rank = np.full(len(rows), NONE, np.int64)
        rank[more] = ranks.pair(least[more], token[rows[more], end[more]])
        put(rows, i, rank)
        p = before[rows, i]
        has = p >= 0
        put(rows[has], p[has], ranks.pair(token[rows[has], p[has]], least[has]))
    flat = token[inside].astype(np.int32).tobytes()
    ends = (4 * np.cumsum(inside.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of bounded length, as far as it has spaces at which a piece always starts."""
    at = 0
    while len(text) - at > PORTION:
        found = _BETWEEN.search(text, at + PORTION)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Encoder:
    """Texts to ids, with the words of this task remembered within bounds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = Ranks(ranks)
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        # Where two white-space characters touch, a piece may reach over a space.
        self.touching = re.compile(r"\s\s").search

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit numbers; pieces of like length are merged together."""
        out = [None if whole is None else np.int32(whole).tobytes() for whole in map(self.ranks.of.get, pieces)]
        sizes: dict[int, list[int]] = {}
        for i, ids in enumerate(out):
            if ids is None:
                sizes.setdefault((len(pieces[i]) - 2).bit_length(), []).append(i)
        for bits, own in sizes.items():
            if bits <= TOGETHER_BITS:
                size = 1 << max(bits, 1)
                step = LEAVES // size
                cuts = [own[at : at + step] for at in range(0, len(own), step)]
                merged = [ids for cut in cuts for ids in merge_many([pieces[i] for i in cut], self.ranks, size)]
            else:
                merged = [np.array(merge(pieces[i], self.ranks.of), np.int32).tobytes() for i in own]
            for i, ids in zip(own, merged, strict=True):
                out[i] = ids
        return out

    def learn(self, words: list[str], starts: list[list[str]]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each word after a space, and of each beginning of a text, given as its pieces."""
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        known = self.words
        # A space and letters are one piece; other words are split by the pattern.
        plain = [word for word in words if word not in known and word.isalpha()]
        mixed = {word: self.split(" " + word) for word in words if word not in known and not word.isalpha()}
        pieces = list(set(chain.from_iterable(chain(mixed.values(), starts))))
        data = (" " + "\n ".join(plain)).encode().split(b"\n") if plain else []
        ids = self.merge_all(data + [piece.encode("utf-8", "surrogatepass") for piece in pieces])
        known.update(zip(plain, ids, strict=False))
        of = dict(zip(pieces, ids[len(plain) :], strict=True)).__getitem__
        for word, own in mixed.items():
            known[word] = b"".join(map(of, own))
        out = [known[word] for word in words]
        for word in words:
            if len(word) > REMEMBERED_LENGTH:
                known.pop(word, None)
        return out, [b"".join(map(of, own)) for own in starts]

    def encode(self, texts: list[str]) -> pa.Array:
        """A list of ids per text. Texts come in portions of bounded size, so that new words merge together."""
        touching = [bool(self.touching(text)) for text in texts]
        # A beginning has no space ahead; a text with touching white space is all beginning.
        starts = [self.split(t if whole else t.partition(" ")[0]) for t, whole in zip(texts, touching, strict=True)]
        spaced = pa.array(["" if whole else t for t, whole in zip(texts, touching, strict=True)], pa.string())
        lists = pc.split_pattern(spaced, " ")
        first = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().copy()
        of_words, of_starts = self.learn(words.dictionary.to_pylist(), starts)
        codes[first[:-1]] = len(of_words) + np.arange(len(texts))
        ids = of_words + of_starts
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values = np.frombuffer(b"".join(ids), np.int32)
        own, ends = sizes[codes], np.cumsum(sizes)
        upto = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat((ends - sizes)[codes] - upto[:-1], own) + np.arange(upto[-1])
        return pa.ListArray.from_arrays(pa.array(upto[first], pa.int32()), pa.array(values[at], pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as array ``into``; each match of ``pattern`` is a piece.

    ``ranks_path`` is read by the tasks: like the interpreter, the file is part of the machines' setup.
    """

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(read_ranks(ranks_path), pattern)
        for batch in batches:
            made, portion, size, firsts = [], [], 0, [0]

            def given() -> pa.Array:
                # The ids of a text are those of its parts, one after the other.
                parts = pa.concat_arrays([*made, encoder.encode(portion)])
                return pa.ListArray.from_arrays(parts.offsets.take(pa.array(firsts)), parts.values)

            for value in batch:
                for part in parts_of(value.as_py() or ""):
                    portion.append(part)
                    size += len(part)
                    if size >= PORTION:
                        made.append(encoder.encode(portion))
                        portion, size = [], 0
                firsts.append(sum(map(len, made)) + len(portion))
                if made:
                    # Ids leave portion by portion, not a whole batch of long texts at once.
                    yield given()
                    made, portion, size, firsts = [], [], 0, [0]
            if len(firsts) > 1 or not len(batch):
                yield given()

    return docs.withColumn(into, ids_of(F.col(text)))


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids in ``ids`` stand for as binary ``into``."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = {rank: data for data, rank in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            numbers, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            spans = zip(ends[:-1], ends[1:], strict=True)
            yield pa.array([b"".join(map(token, numbers[a:b].tolist())) for a, b in spans], pa.binary())

    return rows.withColumn(into, bytes_of(F.col(ids)))
