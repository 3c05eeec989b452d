"""Ranked search, hard negatives, and fingerprints."""

from __future__ import annotations

import collections
import math
import random
import re

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlake.llm import negatives, queries, ranked, simhash
from fleetlake.session import load

DOCS = "doc_id long, text string"


# Ranked search


def ranked_by_all(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return split.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))

    counts = [(key, collections.Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (key, c) in enumerate(counts):
            m = 10 + (90 * c.total() * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, at, key))
        out += [(item, rank + 1, s[-1], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return out


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [7, 1024])
def test_ranked_search_as_by_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "LEAF", 3)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "x1"]
    docs = [(i, " ".join(rng.choice(words[: rng.randrange(5, 63)]) for _ in range(rng.randrange(1, 80)))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(14)] + [(600, None), (601, ""), (602, "-- !"), (None, docs[3][1]), (603, "W1 w1 w1"), (603, "w1")]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 12)))) for i in range(20)]
    items += [(50, docs[3][1]), (50, docs[3][1]), (51, None), (52, "?"), (53, "nowhere"), (54, "W1, w2; É")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("x"), "row": F.lit("y"), "key": F.lit(1)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit("z"))
    expected = collections.Counter(ranked_by_all(docs, items))
    assert rows_of(ranked.search(df, asked).select("item_id", "rank", "doc_id", "score")) == expected
    monkeypatch.setattr(ranked, "TERMS", 40)  # several portions of queries
    assert rows_of(ranked.search(df, asked).select("item_id", "rank", "doc_id", "score")) == expected


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("item_id > 1")), (spark.createDataFrame([(1, None)], DOCS), items)):
        found = ranked.search(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0
    with pytest.raises(TypeError):
        ranked.search(docs.withColumn("doc_id", F.col("doc_id").cast("string")), items)


def test_bounds_of_balls_hold_and_prune():
    rng = np.random.default_rng(5)
    rows, columns, values = [0], [], []
    topics = rng.integers(10**5, 10**6, (8, 20))
    for i in range(400):  # versions of eight texts, each with a few terms of all
        topic = i % 8
        columns.append(np.concatenate([np.unique(rng.integers(0, 10, 3)), 10 + 20 * topic + np.arange(20)]))
        values.append(rng.integers(1, 10**5, len(columns[-1])))
        values[-1][-20:] += topics[topic]
        rows.append(rows[-1] + len(columns[-1]))
    given = ranked.Rows(np.array(rows), np.concatenate(columns), np.concatenate(values))
    tree, order = ranked.Tree.build(given)
    assert sorted(order) == list(range(400))
    tie, opened, leaves = np.arange(400), 0, int((tree.left < 0).sum())
    for topic in range(8):
        terms = 10 + 20 * topic + np.arange(6)
        query = tree.ask(terms, np.full(6, 9000))
        scores, bounds = tree.rows.dot(query), tree.bounds(query)
        for node in range(len(bounds)):
            assert scores[tree.low[node] : tree.high[node]].max() <= bounds[node]
        places, best, scored = tree.search(query, 5, 0, tie)
        assert sorted(best, reverse=True) == sorted(scores, reverse=True)[:5] and (scores[places] == best).all()
        opened += scored
    assert opened < 8 * leaves  # whole subtrees were left out


def test_terms_of_long_texts(monkeypatch):
    text = ("Añb-c9 " * 500 + "x" * 5000 + " end").encode()
    whole = ranked.term_counts(text)
    monkeypatch.setattr(ranked, "_PIECE", 64)
    assert ranked.term_counts(text) == whole and whole["añb".encode()] == whole[b"c9"] == 500


# Hard negatives


def mined_by_all(rows, positives=5, k=5, low=80):
    """(anchor, positive, rank, negative, scores) of (id, vector, label) by all scores."""
    usable = [
        (at, key, [math.floor(256 * x) for x in v], label)
        for at, (key, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, key, q, label in usable:
        if key is None or key % 100:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(q, p, strict=True)), other is None, other or 0, i, mark == label, other)
            for i, other, p, mark in usable
            if i != at and len(p) == len(q)
        )
        for p in [s for s in scored if s[4]][:positives]:
            fits = [s for s in scored if not s[4] and low * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(key, p[5], rank + 1, s[5], -p[0], -s[0]) for rank, s in enumerate(fits[:k])]
    return out


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block", [5, 1024])
def test_negatives_as_by_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ZONES", 4)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    rng = random.Random(block)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 5]], i % 4 if i % 11 else 0) for i in range(260)]
    rows += [(i, rows[0][1], i % 2) for i in range(900, 940)]  # repeated vectors: ties
    nan, inf = float("nan"), float("inf")
    rows += [
        (1000, None, 1), (1100, [1.0] * 6, None), (1200, [nan] * 6, 1), (1300, [inf] + [0.0] * 5, 1), (1400, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
        (1500, [0.5, 0.5], 1), (1501, [0.5, 0.4], 1), (1502, [0.5, 0.45], 2), (1600, [0.9], 3), (1700, [-1.0, -1.0], 1), (200, rows[200][1], 2),
        (None, rows[0][1], 0), (None, rows[0][1], 1), (1800, [], 1), (1801, [], 1), (1802, [], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"row": F.lit("x"), "size": F.lit(1)})
    found = negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"))
    assert found.columns == NAMES and rows_of(found) == collections.Counter(mined_by_all(rows))


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    for rows in (df.limit(0), df):  # nothing at all, and no anchor
        assert negatives.mine(rows, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    with pytest.raises(TypeError):
        negatives.mine(df.withColumn("vec_id", F.lit("a")), F.lit(True), F.col("label"))


def test_hilbert_places_are_neighbours():
    for size, levels in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << levels)] * size, indexing="ij"), -1).reshape(-1, size)
        places = [bytes(p) for p in negatives.hilbert(grid, levels)]
        walk = grid[sorted(range(len(grid)), key=places.__getitem__)]
        assert len(set(places)) == len(grid) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_bounds_hold():
    rng = np.random.default_rng(3)
    anchors, rows = rng.integers(-300, 300, (20, 8)), rng.integers(-300, 300, (50, 8))
    low, high = negatives.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()
    big = rng.integers(1 << 28, 1 << 29, (3, 8))  # sums above 2**53
    assert negatives.products(big, big.T).tolist() == [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in big] for x in big]


# Fingerprints


def fingerprint_by_bits(text):
    w = brute.words(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_by_all(codes, bits=3):
    """The least place of each one's component."""
    codes, root = np.array(codes, np.uint64), list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= bits):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return [find(i) for i in range(len(codes))]


def test_fingerprints_and_groups(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").toPandas().sort_values("doc_id")
    codes = [fingerprint_by_bits(t) for t in docs.text]
    ids = docs.doc_id.tolist()
    expected = {ids[i]: (f"{codes[i]:016x}", ids[r]) for i, r in enumerate(components_by_all(codes))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op13_simhash_groups(spark, sf_dir).collect()} == expected


def test_fingerprint_groups_of_odd_rows(spark):
    base = " ".join(f"w{i % 70}" for i in range(400))
    rows = [(9, base), (3, base + " tail"), (4, base.upper().replace("W", "w")), (None, base), (5, None), (6, ""), (6, " \t"), (2, "one"), (2, "ONE"), (8, "one two")]
    rows += [(None, "alone here only now")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"fingerprint": F.lit("x"), "key": F.lit(1)})
    found = simhash.groups(df).collect()
    assert len(found) == len(rows)
    by = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found)
    codes = [fingerprint_by_bits(t) for _, t in rows]
    groups = components_by_all(codes)
    least = {g: min((rows[i][0] for i in range(len(rows)) if groups[i] == g and rows[i][0] is not None), default=None) for g in groups}
    assert by == collections.Counter((rows[i][0], f"{codes[i]:016x}", least[groups[i]]) for i in range(len(rows)))
    assert simhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprint_of_a_long_text_in_parts(monkeypatch):
    text = " ".join(f"v{i % 911}" for i in range(3000))
    monkeypatch.setattr(simhash, "_PART", 7)
    assert simhash.fingerprint(text.encode()) == fingerprint_by_bits(text)


@pytest.mark.parametrize("block", [16, 8192])
def test_links_of_crowded_codes(spark, monkeypatch, block):
    """Clusters whose members share their leading bits, spread over several blocks, and codes on the edge of three bits."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    codes = {0, (1 << 64) - 1, 7, 15}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            code = centre
            for _ in range(rng.randrange(6)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    codes |= {rng.getrandbits(64) for _ in range(200)}
    codes = sorted(codes)
    expected = components_by_all(codes)
    nodes = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fingerprint long")
    edges = [(int(a) % (1 << 64), int(b) % (1 << 64)) for a, b in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges) and edges
    place, root = {c: i for i, c in enumerate(codes)}, list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert [find(i) for i in range(len(codes))] == expected


def test_index_leaves_out_groups():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64))
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    index = simhash.Index(codes[np.argsort(rank)])
    near = index.value[-1][:50] ^ np.uint64(0b10011)
    found = [(int(q), int(n)) for a, b in index.search(near, 16) for q, n in zip(a, b, strict=True)]
    distance = np.bitwise_count(near[:, None] ^ index.value[-1][None])
    lead = (near[:, None] ^ index.value[-1][None]) >> np.uint64(48) == 0
    assert sorted(found) == sorted(zip(*(x.tolist() for x in np.nonzero((distance <= 3) & lead)), strict=True))
