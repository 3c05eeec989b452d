"""Common substrings of text pairs and compression dictionaries built from them."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordered import running_total

# Limits of the matching that decompressors allow for.
MIN_MATCH = 3
MAX_MATCH = 257
WINDOW = 32506
#: Texts up to this length are searched as a whole, which is faster than to note their places.
SHORT = 4096
#: Places that are tried one by one; more are searched.
FEW = 8
#: Lengths of the runs that keys are sought by.
GRAMS = (1, 2, 3, 6, 16)


class _Places:
    """Earlier places of a text by the three characters there, so that a match is sought only where one can be."""

    def __init__(self, data: str) -> None:
        self.data, self.chains, self.upto = data, defaultdict(list), 0
        self.compared = 0

    def longest(self, pos: int) -> int:
        """Length of the longest earlier occurrence of the text at ``pos``; 0 below the minimum. Asked with rising ``pos``."""
        data, chains = self.data, self.chains
        if len(data) <= SHORT:
            return self._searched(pos, 0, min(MAX_MATCH, len(data) - pos))
        for at in range(self.upto, pos):
            chains[data[at : at + MIN_MATCH]].append(at)
        self.upto = pos
        chain = chains.get(data[pos : pos + MIN_MATCH])
        most = min(MAX_MATCH, len(data) - pos)
        if not chain or most < MIN_MATCH:
            return 0
        first = bisect.bisect_left(chain, pos - WINDOW) if chain[0] < pos - WINDOW else 0
        if len(chain) - first > FEW:
            return self._searched(pos, chain[first], most)
        best, wanted = 0, data[pos : pos + MIN_MATCH]
        for at in chain[first:]:
            self.compared += 1
            if data.startswith(wanted, at):
                best = len(wanted)
                while best < most and data[at + best] == data[pos + best]:
                    best += 1
                if best == most:
                    break
                wanted = data[pos : pos + best + 1]  # only a longer match is better
        return best

    def _searched(self, pos: int, low: int, most: int) -> int:
        """The same for many places, which lie close together: each search begins behind the last match, a character longer."""
        data, best, length = self.data, 0, MIN_MATCH
        while length <= most:
            at = data.find(data[pos : pos + length], low, pos + length - 1)
            self.compared += 1
            if at < 0:
                break
            while length < most and data[at + length] == data[pos + length]:
                length += 1
            best, low = length, at + 1
            length += 1
        return best


def _walk(text: str, known: str) -> set[str]:
    """What a greedy walk over ``text`` copies from ``known`` or from itself."""
    data, found = known + text, set()
    places, pos = _Places(data), len(known)
    while pos < len(data):
        length = places.longest(pos)
        if length:
            found.add(data[pos : pos + length])
        pos += length or 1
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def common_substrings(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Substrings that a compressor would copy both from the first text to the second and back."""
    for first, second in batches:
        yield pd.Series(
            [
                sorted(_walk(a, b) & _walk(b, a)) if a is not None and b is not None else []
                for a, b in zip(first, second)
            ],
            index=first.index,
            dtype=object,
        )


def mine_pairs(pairs: DataFrame, a: str, b: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, substr): one row per pair and common substring."""
    return pairs.select(*keep, F.explode(common_substrings(F.col(a), F.col(b))).alias("substr"))


def substring_freq(mined: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, substr, freq): in how many pairs each substring is common."""
    return mined.groupBy(*keys, "substr").agg(F.count(F.lit(1)).alias("freq"))


def freqs_descending(freqs: DataFrame) -> DataFrame:
    """Frequencies, most frequent first; ties in text order. A range-partitioned sort."""
    return freqs.orderBy(F.col("freq").desc(), "substr")


def _grams(n: Column) -> Column:
    """The different runs of ``n`` characters of ``key``."""
    starts = F.sequence(F.lit(1), F.length("key") - n + 1)
    return F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("key"), s, n)))


def _containments(keys: DataFrame, group: Sequence[str]) -> DataFrame:
    """(id, holder): every key inside a longer key of its group.

    A key is sought by an anchor, the rarest of its runs of a fixed length (``GRAMS``; the longest that fits it). Keys
    that hold the anchor are joined on equality, and then asked whether they contain the key. So a key gives out its
    runs of a few lengths, and not all of its substrings.
    """
    length = F.length("key")
    fits: Column = F.lit(GRAMS[0])
    for n in GRAMS[1:]:
        fits = F.when(length >= n, n).otherwise(fits)
    sized = keys.select(*group, "id", "key", fits.alias("fits"))
    used = sized.select(*group, F.col("fits").alias("n")).distinct()
    each = F.explode(F.filter(F.array(*[F.lit(n) for n in GRAMS]), lambda n: n <= length)).alias("n")
    runs = sized.select(*group, "id", "key", "fits", each).join(used, [*group, "n"], "left_semi")
    grams = materialize(
        runs.select(*group, "n", "id", (F.col("n") == F.col("fits")).alias("own"), length.alias("size"), F.explode(_grams(F.col("n"))).alias("gram")),
        "key-grams",
    )
    rare = grams.groupBy(*group, "n", "gram").agg(F.count(F.lit(1)).alias("holders"))
    anchors = (
        grams.where("own")
        .join(rare, [*group, "n", "gram"])
        .groupBy(*group, "n", "id", "size")
        .agg(F.min(F.struct("holders", "gram"))["gram"].alias("gram"))
    )
    longer = grams.select(*group, "n", "gram", F.col("id").alias("holder"), F.col("size").alias("holder_size"))
    pairs = anchors.join(longer, [*group, "n", "gram"]).where("holder_size > size").select("id", "holder")
    texts = keys.select("id", "key")
    return (
        pairs.join(texts, "id")
        .join(texts.select(F.col("id").alias("holder"), F.col("key").alias("holder_key")), "holder")
        .where(F.contains("holder_key", "key"))
        .select("id", "holder")
    )


def swallow(freqs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, key, freq, score) of the keys inside no longer key, with the scores they take in.

    A key scores its length times its frequency. By ascending length (then descending frequency,
    then text) each key hands its score to the longer key containing it that scores highest at
    that moment, the first in that order among equals.

    Every choice depends on earlier ones only, so the sequence is solved by rounds: all keys
    choose at once, given the scores that the last round's choices imply at each key's turn,
    until no choice or score changes. The settled state is the sequential result. A holder's
    group is limited by the number of its substrings; a key held by very many is combined
    map-side.
    """
    ordered = freqs.select(*group, F.col("substr").alias("key"), F.col("freq").cast("long").alias("freq"))
    ordered = ordered.where("length(key) > 0 AND freq > 0").orderBy(F.length("key"), F.col("freq").desc(), "key")
    # Ids follow the processing order: the sort is global, and the table is written once.
    keys = materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "keys")
    keys = keys.withColumn("own", F.length("key") * F.col("freq"))
    edges = _containments(keys, group)
    edges = materialize(
        edges.join(keys.select(F.col("id").alias("holder"), F.col("own").alias("holder_own")), "holder"), "edges"
    )
    state = keys.select("id", F.col("own").alias("mass"), F.lit(None).cast("long").alias("choice"))
    earlier = Window.partitionBy("holder").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        given = F.when(F.col("choice") == F.col("holder"), F.col("mass")).otherwise(F.lit(0))
        at_turn = edges.join(state, "id").select(
            "id", "holder", (F.col("holder_own") + F.coalesce(F.sum(given).over(earlier), F.lit(0))).alias("score")
        )
        chosen = at_turn.groupBy("id").agg(
            F.min_by("holder", F.struct((-F.col("score")).alias("s"), "holder")).alias("choice")
        )
        taken = (
            state.where("choice IS NOT NULL").groupBy(F.col("choice").alias("id")).agg(F.sum("mass").alias("taken"))
        )
        following = (
            keys.select("id", "own")
            .join(taken, "id", "left")
            .join(chosen, "id", "left")
            .select("id", (F.col("own") + F.coalesce("taken", F.lit(0))).alias("mass"), "choice")
        )
        following = materialize(following, "state")
        same = (F.col("n.mass") == F.col("o.mass")) & F.col("n.choice").eqNullSafe(F.col("o.choice"))
        changed = following.alias("n").join(state.alias("o"), "id").where(~same)
        state = following
        if changed.isEmpty():
            break
    kept = state.where("choice IS NULL").select("id", F.col("mass").alias("score"))
    return keys.join(kept, "id").select(*group, "key", "freq", "score", "id")


def dictionary_entries(freqs: DataFrame, size: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, key, score, tail): what goes into a dictionary of ``size`` characters.

    ``tail`` is the number of characters after the entry. The best scores come last; the entry
    that does not fit loses its beginning. A size of 0 or below keeps everything.
    """
    kept = swallow(freqs, group)
    if size > 0:
        # Scores whose better ones fill the dictionary already cannot get in.
        per_score = kept.groupBy(*group, "score").agg(F.sum(F.length("key")).alias("chars"))
        doubling = F.floor(F.log2(F.col("score").cast("double"))).cast("long")
        useful = running_total(per_score, group, "score", doubling, {"through": F.col("chars")}, descending=True)
        useful = useful.where(F.col("through") - F.col("chars") < size).select(*group, "score")
        kept = kept.join(useful, [*group, "score"], "left_semi")
    # From the end: highest score first, among equals the one that comes last in input order.
    ranked = kept.withColumn("__rank", F.struct("score", (-F.col("freq")).alias("f"), "key"))
    slices = F.struct("score", (-F.col("freq")).alias("f"), F.ascii("key").alias("c"))
    placed = running_total(ranked, group, "__rank", slices, {"through": F.length("key")}, descending=True)
    placed = placed.withColumn("tail", F.col("through") - F.length("key"))
    if size > 0:
        room = F.lit(size) - F.col("tail")
        placed = placed.where(room > 0).withColumn("key", F.right("key", room.cast("int")))
    return placed.select(*group, "key", "score", F.col("tail").cast("long").alias("tail"))


def build_dictionary(freqs: DataFrame, size: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, dictionary): the last ``size`` characters of all entries in ascending score.

    Needs a positive size, which bounds the text that is put together; use
    ``dictionary_entries`` for everything.
    """
    if size <= 0:
        raise ValueError("a dictionary text needs a size; dictionary_entries has none")
    entries = dictionary_entries(freqs, size, group)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("tail")).alias("t"), "key")))
    text = F.array_join(F.transform(parts, lambda p: p["key"]), "")
    return entries.groupBy(*group).agg(text.alias("dictionary"))
