"""Near-duplicate groups by b-bit MinHash.

A document is the set of its runs of five lower-cased words. Bands of minima of a set, hashed, make the
buckets in which candidates meet. Sets that share a bucket get ``MINIMA`` more minima, of which only the
low ``BITS`` bits are kept, packed. The share of equal low bits, counted on the packed words and
corrected for chance agreement, estimates the similarity of a candidate pair. Pairs that may reach the
threshold are confirmed on the full sets of their texts; confirmed links make the groups.

No pairs are spelt out within large groups:

1. Documents with equal sets are one node from the start.
2. Every set meets the pivot of each of its buckets, one pivot per bucket. The best one by estimate is
   confirmed, then those whose groups still differ. The links found join most of a large group.
3. What may still be missed are links between different groups. Only buckets that hold more than one
   group are looked at, and in them only pairs of different groups, within the join's condition: size
   and estimate have to allow the threshold, so what comes out are pairs to confirm. Crowded buckets are
   cut into portions that meet portion by portion.

The groups are the connected components of all links among candidates. A pair of the threshold's similarity or
more misses all bands with a probability below 1e-6, and is dropped by the estimate with about the same.

Words are hashed to 64 bits; sets are compared as sets of such numbers. Groups are found by alternating
large-star and small-star steps, each written to the shared folder; only counts reach the driver.

Defined cases: a text that is null or has no word has an empty set and is linked with nothing. One with
fewer than five words has one run, all of it. Null ids come last: a group's id is its smallest id, and
null if it has none but null ones. Rows with the same id and text are the same document and share the
verdict. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, mix64, rolling

RUN = 5
BANDS, ROWS = 25, 5
MINIMA, BITS = 768, 2
SIMILARITY = 85  # hundredths
#: Estimates of this much less than the threshold are still confirmed: 4.5 standard deviations.
MARGIN = 0.068
#: Largest probability that a pair at the threshold misses all bands.
MISSED = 1e-6
#: Sets of a bucket that meet in one portion.
PORTION = 1024
SEED = 11


def shingles(words: Words, data: bytes, run: int = RUN) -> np.ndarray:
    """The distinct runs of a text as sorted numbers."""
    numbers, _ = words.hashes(data.lower())  # of bytes, so that only A to Z change
    if not len(numbers):
        return numbers
    return np.unique(rolling(numbers, min(run, len(numbers))) + np.uint64(min(run, len(numbers))))


def bands_for(similarity: int) -> int:
    """Bands that a pair of this similarity (hundredths) misses with a probability of ``MISSED`` at most."""
    return max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-((similarity / 100) ** ROWS))))


def margin_for(similarity: int) -> float:
    """``MARGIN`` for a lower threshold, where estimates vary more."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * similarity / 100
    return max(MARGIN, 4.5 * math.sqrt(equal * (1 - equal) / MINIMA) / (1 - chance))


class MinHash:
    """``count`` minima of sets; one per task and use."""

    def __init__(self, count: int, seed: int = SEED) -> None:
        rng = np.random.default_rng([seed, count])
        self.times = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, count, np.uint64)
        self.band = mix64(np.arange(1, count // ROWS + 1, dtype=np.uint64))

    def minima(self, runs: np.ndarray) -> np.ndarray:
        least = np.full(len(self.plus), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(runs), 512):
            part = runs[at : at + 512, None] * self.times + self.plus
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def bands(self, least: np.ndarray) -> np.ndarray:
        rows = least.reshape(-1, ROWS)
        out = self.band.copy()
        for r in range(ROWS):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
        return out.view(np.int64)

    def packed(self, least: np.ndarray) -> np.ndarray:
        """The low bits of the minima, 64 / BITS of them in a number.

        Mixed first: the low bits of the minima as they are depend on those of the runs alone, alike for all.
        """
        low = (mix64(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
        shifts = np.arange(0, 64, BITS, dtype=np.uint64)
        return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)


def signatures(docs: DataFrame, text: str = "text", into: str = "sig", count: int = BANDS) -> DataFrame:
    """``docs`` with a struct ``into``: n, set1, set2 (which name the set), bands."""

    @F.arrow_udf("struct<n:bigint,set1:bigint,set2:bigint,bands:array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, minhash = Words(), MinHash(count * ROWS)
        for batch in batches:
            n, one, two, bands = [], [], [], []
            for value in batch:
                runs = shingles(words, (value.as_py() or b""))
                n.append(len(runs))
                if not len(runs):
                    one.append(None), two.append(None), bands.append(None)
                    continue
                one.append(int(runs.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix64(runs ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(minhash.bands(minhash.minima(runs)))
            numbers = [pa.array(x, pa.int64()) for x in (n, one, two)]
            yield pa.StructArray.from_arrays(
                [*numbers, pa.array(bands, pa.list_(pa.int64()))], ["n", "set1", "set2", "bands"]
            )

    return docs.withColumn(into, sign(F.col(text).cast("binary")))


def low_bits(docs: DataFrame, text: str = "text", into: str = "bits") -> DataFrame:
    """``docs`` with the packed low bits of ``MINIMA`` minima of each text's set."""

    @F.arrow_udf("array<bigint>")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, minhash = Words(), MinHash(MINIMA)
        for batch in batches:
            made = [minhash.packed(minhash.minima(shingles(words, value.as_py() or b""))) for value in batch]
            yield pa.array(made, pa.list_(pa.int64()))

    return docs.withColumn(into, pack(F.col(text).cast("binary")))


def estimate(a: str, b: str) -> Column:
    """Similarity by the packed bits ``a`` and ``b``: equal minima per bit count, less chance agreement."""
    mask = 0x5555555555555555
    unequal: Column = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(mask)))
    chance = 2.0**-BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def _may_link(similarity: int) -> Column:
    """Whether sets with sizes n_a, n_b and bits bits_a, bits_b may reach the similarity."""
    sizes = 100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    return sizes & (estimate("bits_a", "bits_b") >= similarity / 100 - margin_for(similarity))


def confirm(pairs: DataFrame, texts: DataFrame, similarity: int, run: int = RUN) -> DataFrame:
    """The pairs (a, b) whose texts' sets reach the similarity; ``texts`` has id and text."""

    @F.arrow_udf("boolean")
    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = Words()
        for left, right in batches:
            out, known, last = [], None, None
            for a, b in zip(left, right, strict=True):
                a, b = a.as_py(), b.as_py()
                if a != known:
                    known, last = a, shingles(words, a, run)
                other = shingles(words, b, run)
                both = len(np.intersect1d(last, other, assume_unique=True))
                out.append(100 * both >= similarity * (len(last) + len(other) - both))
            yield pa.array(out, pa.bool_())

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .where(linked(F.col("text_a").cast("binary"), F.col("text_b").cast("binary")))
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the smallest id of its connected component."""
    now = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        return row[0], row[1]

    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        following = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(following)
        now, stable, seen = following, after == seen, after
        if stable:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """For each row of ``docs``: key, text1, text2 (hashes of the text), n_shingles, component_id, kept."""
    hashes = {"text1": F.xxhash64(text), "text2": F.hash(text)}
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[c.alias(n) for n, c in hashes.items()])
    signed = materialize(
        signatures(slim, count=bands_for(similarity)).select(F.monotonically_increasing_id().alias("row"), "key", "text1", "text2", "sig.*"),
        "signatures",
    )
    sets = materialize(
        signed.where("n > 0")
        .groupBy("set1", "set2")
        .agg(
            F.min("row").alias("id"),
            F.min("key").alias("least_key"),
            F.min(F.struct("text1", "text2")).alias("t"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        ),
        "sets",
    )
    placed = sets.select("id", F.explode("bands").alias("bucket"))
    crowded = (
        placed.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("bucket", "id"), "id"))["id"].alias("pivot"))
        .where("members > 1")
    )
    shared = materialize(placed.join(crowded, "bucket"), "shared-buckets")
    near = shared.select("id").distinct()
    wanted = sets.join(near, "id").select("id", "n", "t.text1", "t.text2")
    candidates = (
        docs.select(F.col(text).alias("text"), *[c.alias(n) for n, c in hashes.items()])
        .join(wanted.hint("shuffle_hash"), ["text1", "text2"])
        .groupBy("id")
        .agg(F.first("text").alias("text"), F.first("n").alias("n"))
    )
    texts = materialize(low_bits(candidates), "candidate-texts")
    bits = texts.select("id", "n", "bits")
    side = {x: bits.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"}
    stars = materialize(
        shared.where("id <> pivot")
        .select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        .distinct()
        .join(side["b"], "b")
        .join(side["a"], "a")
        .where(_may_link(similarity))
        .select("a", "b", estimate("bits_a", "bits_b").alias("similar")),
        "stars",
    )
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("similar", -F.col("a"))).alias("a"))
    linked = materialize(confirm(best, texts, similarity), "links")
    known = materialize(components(linked), "groups")
    root = {x: known.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"}
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    others = stars.select("a", "b").join(root["a"], "a", "left").join(root["b"], "b", "left").where(apart)
    more = confirm(others.select("a", "b"), texts, similarity)
    first = materialize(components(linked.select("a", "b").union(more)), "groups")
    members = shared.join(first, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"), "members")
    mixed = members.groupBy("bucket").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l < h").select("bucket")
    portions = F.ceil(F.col("members") / PORTION)
    own = F.pmod(F.xxhash64("id"), portions)
    rows = members.join(mixed, "bucket").join(bits, "id").join(sets.select("id", "bands"), "id").withColumns({"own": own, "every": F.sequence(F.lit(0).cast("long"), portions - 1)})
    left, right = (
        rows.select(
            "bucket",
            *( [F.col("own").alias("p"), F.explode("every").alias("q")] if x == "a" else [F.explode("every").alias("p"), F.col("own").alias("q")] ),
            F.col("id").alias(x), F.col("root").alias(f"root_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"),
            F.col("bands").alias(f"bands_{x}"),
        )
        for x in "ab"
    )
    # A pair comes out of the first bucket it shares only.
    common = F.filter(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    first_common = F.get(common, F.lit(0)) == left["bucket"]
    across = (
        left.join(
            right,
            (left["bucket"] == right["bucket"]) & (left["p"] == right["p"]) & (left["q"] == right["q"])
            & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _may_link(similarity) & first_common,
        )
        .select("a", "b", "root_a", "root_b")
    )
    links = confirm(across.select("a", "b"), texts, similarity).join(across, ["a", "b"])
    second = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    roots = (
        sets.select("set1", "set2", "id", "least_key")
        .join(first, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
        .join(second.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
        .withColumn("top", F.coalesce("top", "root"))
    )
    names = roots.groupBy("top").agg(F.min("least_key").alias("component"))
    named = roots.join(names, "top").select("set1", "set2", "component")
    found = signed.join(named, ["set1", "set2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return found.select(
        F.col("key").alias(key),
        "text1",
        "text2",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` less all but the document with the smallest id of each group."""
    kept = (
        groups(docs, key, text, similarity)
        .where("kept")
        .select(F.col(key).alias("__key"), F.col("text1").alias("__1"), F.col("text2").alias("__2"))
    )
    same = (
        docs[key].eqNullSafe(F.col("__key"))
        & (F.xxhash64(docs[text]) == F.col("__1"))
        & (F.hash(docs[text]) == F.col("__2"))
    )
    return docs.join(kept.hint("shuffle_hash"), same, "left_semi")
