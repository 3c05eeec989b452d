"""Language identification by nearest centroid.

A text becomes a vector of hashed letter runs (one to three letters, word borders counted) weighted by
term frequency and inverse document frequency, of length one. Each language has several centroids,
found by spherical k-means over its labelled sample. The nearest centroid by cosine names the
language; a text farther from it than the centroid's own radius is marked as rejected.

Fitting reads a bounded, documented sample (``SAMPLE`` labelled rows in all, shared out evenly over the
languages: of each those with the least hashes of key and text). The texts of the sample are turned into vectors by the tasks, so what
reaches the driver is at most ``SAMPLE`` vectors of ``DIMENSIONS`` entries. Prediction covers every
whole text by itself, without a shuffle; it sees the text alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected, and so is
every text if nothing is labelled. A language none of whose sampled texts
has a letter has no centroid. Null and repeated keys are sampled by their texts. Ties go to the language first in order. Rows that repeat are judged
each for itself. Extra columns are kept; a column with the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 4096
SAMPLE = 4000
CENTROIDS = 4
ROUNDS = 12
#: A centroid's radius is this times the distance within which nearly all its sample lies.
SLACK = 1.25
UNDETERMINED = "und"
_PART = 1 << 20


class Grams:
    """Counts of hashed letter runs; one per task."""

    def __init__(self) -> None:
        self._letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """Counts by bin, or None for a text without a letter."""
        out, at, text = None, 0, (text or "").lower()
        while at < len(text) or not at:
            end = len(text)
            if end - at > _PART and (space := text.find(" ", at + _PART)) >= 0:
                end = space + 1  # no run of letters reaches over a space
            found = self._of_part(text[at:end])
            if found is not None:
                out = found if out is None else out + found
            at = max(end, 1)
        return out

    def _of_part(self, text: str) -> np.ndarray | None:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        letter = self._letter[np.minimum(points, 0xFFFF)]
        if len(points) and points.max() > 0xFFFF:
            for i in np.flatnonzero(points > 0xFFFF):
                letter[i] = chr(points[i]).isalpha()
        if not letter.any():
            return None
        run = np.zeros(len(points) + 2, np.uint64)
        run[1:-1] = np.where(letter, points, 0)
        keep = np.ones(len(run), bool)
        keep[1:] = (run[1:] != 0) | (run[:-1] != 0)  # one border between words
        run = run[keep]
        one, two = run[run != 0], run[:-1] * np.uint64(0x10001) + run[1:] * np.uint64(0x9E3779B1)
        three = (two[:-1] * np.uint64(0x85EBCA6B) + run[2:] * np.uint64(0xC2B2AE35))[run[1:-1] != 0]
        bins = [(x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52) for x in (one, two + np.uint64(1 << 40), three)]
        return np.bincount(np.concatenate(bins).astype(np.int64), minlength=DIMENSIONS)


@dataclass
class Model:
    """Languages in order, and for each centroid its vector, language and radius."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    radius: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        return weighted / max(float(np.linalg.norm(weighted)), 1e-12)

    def predict(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        """Language, cosine with the nearest centroid, and whether it is too far."""
        if counts is None or not self.languages:
            return UNDETERMINED, 0.0, True
        near = self.centroids @ self.vector(counts).astype(np.float32)
        best = int(near.argmax())
        score = min(max(float(near[best]), 0.0), 1.0)
        return self.languages[self.language[best]], score, 1 - score > self.radius[best]


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are far from each other, so a rerun agrees."""
    centres = [vectors[0]]
    while len(centres) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.stack(centres).T, axis=1)
        centres.append(vectors[int(nearest.argmin())])
    centres = np.stack(centres)
    for _ in range(ROUNDS):
        belongs = (vectors @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mean = vectors[belongs == c].sum(axis=0)
            if (length := np.linalg.norm(mean)) > 0:
                centres[c] = mean / length
    return centres


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``labelled`` whose text and label are set; ``key`` only picks the sample."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).where("l IS NOT NULL AND t IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("k", "t"))
    share = max(1, sample // max(rows.select("l").distinct().count(), 1))
    # Each task keeps the least hashes of what it reads, so a language of any size moves few rows, and texts move only for the sample.
    least = Window.partitionBy("l").orderBy("h")
    first = rows.select("l", "h", F.row_number().over(least).alias("r")).where(F.col("r") <= share)
    bound: Column = F.lit(None).cast("long")
    for r in first.groupBy("l").agg(F.max("h").alias("h")).collect():  # a line per language
        bound = F.when(F.col("l") == r["l"], r["h"]).otherwise(bound)
    order = Window.partitionBy("l").orderBy("h", "k", "t")
    taken = rows.where(F.col("h") <= bound).withColumn("r", F.row_number().over(order)).where(F.col("r") <= share)

    @F.arrow_udf("struct<bins:array<smallint>,counts:array<int>>")
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for batch in batches:
            found = [grams.counts(value.as_py()) for value in batch]
            bins = [np.flatnonzero(c) if c is not None else np.empty(0, np.int64) for c in found]
            counts = [c[b] if c is not None else np.empty(0, np.int64) for c, b in zip(found, bins, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(bins, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.int32()))], ["bins", "counts"]
            )

    gathered = taken.select("l", "k", sparse("t").alias("v")).where(F.size("v.bins") > 0).select("l", "k", "v.*").toPandas()
    gathered = gathered.sort_values(["l", "k"], kind="stable")
    languages = sorted(gathered["l"].unique())
    matrix = np.zeros((len(gathered), DIMENSIONS), np.float32)
    for i, (bins, counts) in enumerate(zip(gathered["bins"], gathered["counts"], strict=True)):
        matrix[i, np.asarray(bins, np.int64)] = counts
    idf = np.log((1 + len(matrix)) / (1 + (matrix > 0).sum(axis=0))) + 1
    matrix = np.log1p(matrix) * idf
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    centroids, language, radius = [], [], []
    for i, label in enumerate(languages):
        own = matrix[(gathered["l"] == label).to_numpy()]
        centres = _cluster(own, CENTROIDS)
        near = own @ centres.T
        for c in range(len(centres)):
            inside = 1 - near[near.argmax(axis=1) == c, c]
            centroids.append(centres[c])
            language.append(i)
            radius.append(SLACK * float(np.quantile(inside, 0.99)) if len(inside) else 0.0)
    shape = np.stack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32)
    return Model(list(languages), idf, shape, np.array(language, int), np.array(radius))


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` of lang, score and rejected."""
    languages, idf, centroids, language, radius = model.languages, model.idf, model.centroids, model.language, model.radius

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, own = Grams(), Model(languages, idf, centroids, language, radius)
        for batch in batches:
            rows = [own.predict(grams.counts(value.as_py())) for value in batch]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["lang", "score", "rejected"],
            )

    return docs.withColumn(into, named(F.col(text)))
