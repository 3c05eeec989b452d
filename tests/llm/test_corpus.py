"""Operators that bring documents, or vectors, together; the pipeline."""

from __future__ import annotations

import collections
import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlake.llm import line_dedup, mixing, near_dedup, queries, vectors
from fleetlake.session import load

SCHEMA = "doc_id long, text string"


def documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").toPandas().set_index("doc_id")


def test_vectors_as_by_all_distances(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").toPandas()
    points = np.stack(rows.embedding.to_numpy()).astype(float)
    found = queries.op4_nearest_vectors(spark, sf_dir).toPandas()
    hits = total = 0
    for i in np.flatnonzero(rows.vec_id % 100 == 0):
        far = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        far[i] = np.inf
        best = np.lexsort((rows.vec_id, far))[:10]
        own = found[found.query_id == rows.vec_id[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        hits, total = hits + len(set(own.vec_id) & set(rows.vec_id[best])), total + 10
        assert np.allclose(own.score, np.sort(far)[:10], rtol=0, atol=1e-9) or hits < total
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, 2.0]) for i in range(30)] + [
        (100, None), (100, []), (100, [0.0, 0.0, 0.0]), (100, [1.0, None, 1.0]), (100, [nan, 1.0, 1.0]), (100, [inf, 1.0, 1.0]),
        (100, [0.0, 1.0, 2.0]), (100, [0.0, 1.0, 2.0]), (200, [1.0, 2.0]), (201, [1.0, 3.0]), (None, [0.0, 1.0, 2.0]),
        (300, [1.0]), (301, [-1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    found = vectors.nearest(df, F.col("vec_id") % 100 == 0, k=4).toPandas()
    by = {q: g.sort_values("rank") for q, g in found.groupby("query_id")}
    assert by[0].vec_id.tolist() == [3, 6, 9, 12] and by[0].score.tolist() == [0.0] * 4
    assert len(by[100]) == 8  # two rows with this id take part, each a query of its own
    assert by[200].vec_id.tolist() == [201] and by[300].vec_id.tolist() == [301]
    assert vectors.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_parts_of_the_nearest(spark, sf_dir):
    """Whatever columns are asked for."""
    found = queries.op4_nearest_vectors(spark, sf_dir)
    rows = found.toPandas()
    assert found.count() == len(rows) and found.groupBy("vec_id").count().count() == rows.vec_id.nunique()
    assert sorted(r["score"] for r in found.select("score").collect()) == sorted(rows.score)
    assert found.agg(F.sum("score")).first()[0] == pytest.approx(rows.score.sum())
    with pytest.raises(TypeError):
        vectors.nearest(load(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))
    small = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), "embedding")
    assert vectors.nearest(small, F.col("vec_id") % 100 == 0).count() == len(rows)


def test_estimates_hold_their_bound():
    rng = np.random.default_rng(2)
    points, mean, turn = rng.standard_normal((2000, 64)), np.zeros(64), vectors.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, length, own = vectors.codes(points, mean, turn)
    query = rng.standard_normal(64)
    turned = turn @ (query / np.linalg.norm(query))
    signs = np.unpackbits(bits, axis=1)[:, :64] * 2.0 - 1
    guess = signs @ turned / 8 / own
    true = points @ query / length / np.linalg.norm(query)
    error = np.sqrt(1 - own**2) / own * vectors.BOUND / np.sqrt(63)
    assert (np.abs(guess - true) <= error).mean() > 0.97


@pytest.mark.parametrize("copies", [1, 40])
def test_near_groups(spark, sf_dir, copies):
    if copies == 1:
        rows = list(documents(spark, sf_dir).text.items())
    else:  # a large group of near copies, some linked only through others, and exact copies
        rng = random.Random(4)
        base = [f"w{rng.randrange(500)}" for _ in range(90)]
        rows = []
        for i in range(copies * 3):
            text = list(base)
            for _ in range(i % 4):
                text[rng.randrange(90)] = f"x{rng.randrange(9)}"
            rows.append((i, " ".join(text)))
        rows += [(1000 + i, " ".join(base).upper().replace("X", "x").replace("W", "w" if i else "W")) for i in range(5)]
        rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  two"), (2004, "one"), (2005, " \t"), (2006, "a " * 9)]
    expected = brute.near_groups(rows)
    found = near_dedup.groups(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_groups_in_portions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PORTION", 3)
    rng = random.Random(9)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(99)}" for _ in range(60)]
        for i in range(12):
            text = list(base)
            text[rng.randrange(60)] = f"y{i}"
            text[rng.randrange(60)] = f"z{i}"
            rows.append((family * 100 + i, " ".join(text)))
    expected = brute.near_groups(rows)
    found = near_dedup.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: v[1] for k, v in expected.items()}


def test_near_groups_of_null_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (7, "other words here"), (None, "alone")]
    found = near_dedup.groups(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(found[found.n_shingles == 26].component_id) == [5, 5, 5]
    assert found.kept.sum() == 4  # the null id in the group goes
    assert near_dedup.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = near_dedup.dedup(spark.createDataFrame([*rows, (9, text), (10, None)], SCHEMA).withColumn("n", F.lit(1)))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 5, 5, 7, 10]


def test_similarity_from_bits():
    made, banded = near_dedup.MinHash(near_dedup.MINIMA), near_dedup.MinHash(125)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, np.uint64)
    a, b = pool[:2000], pool[200:2200]  # 1800 of 2200
    equal = (made.minima(a) & np.uint64(3)) == (made.minima(b) & np.uint64(3))
    assert abs((equal.mean() - 0.25) / 0.75 - 1800 / 2200) < near_dedup.MARGIN
    assert len(made.packed(made.minima(a))) == near_dedup.MINIMA // 32 and len(banded.bands(banded.minima(a))) == 25


def test_small_sets_at_the_threshold_are_candidates():
    made, rng = near_dedup.MinHash(near_dedup.MINIMA), np.random.default_rng(7)
    mask = np.uint64(0x5555555555555555)

    def bits(runs):
        return made.packed(made.minima(runs)).view(np.uint64)

    missed = 0
    for both, only_a, only_b in ((6, 0, 1), (17, 1, 2), (17, 0, 3), (34, 3, 3), (34, 0, 6), (12, 1, 1)):
        for _ in range(1500):
            pool = rng.integers(0, 1 << 64, both + only_a + only_b, np.uint64)
            x = bits(pool[: both + only_a]) ^ bits(np.concatenate([pool[:both], pool[both + only_a :]]))
            unequal = int(np.bitwise_count((x | (x >> np.uint64(1))) & mask).sum())
            missed += (1 - unequal / near_dedup.MINIMA - 0.25) / 0.75 < both / len(pool) - near_dedup.MARGIN
    assert missed == 0


def test_near_stage_links_from_80(spark):
    rng, rows = random.Random(12), []
    for family in range(40):
        base = [f"f{family}w{i}" for i in range(44)]  # 40 runs; k changed words at the end leave 40 - k
        for k in (0, 4, 5):
            rows.append((len(rows), " ".join([*base[: 44 - k], *(f"n{rng.random()}" for _ in range(k))])))
    expected = brute.near_groups(rows, 80)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert kept == {k for k, v in expected.items() if k == v[1]} != {k for k, v in brute.near_groups(rows).items() if k == v[1]}
    assert near_dedup.bands_for(85) == near_dedup.BANDS and (1 - 0.8**5) ** near_dedup.bands_for(80) <= 1e-6


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in found} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_cuts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = queries.op6_line_dedup(spark, sf_dir).toPandas().set_index("doc_id")
    for key, (text, lost) in brute.cut_lines(docs.text.items()).items():
        assert (found.loc[key].text, found.loc[key].n_removed) == (text, lost)


def test_line_cuts_of_random_runs(spark):
    rng = random.Random(6)
    pool = [" ".join(f"l{i}w{k}" for k in range(rng.choice([1, 3, 8, 20, 60]))) for i in range(30)]
    rows = []
    for i in range(60):
        lines = []
        while len(lines) < rng.randrange(1, 25):
            at = rng.randrange(len(pool))
            lines += pool[at : at + rng.randrange(1, 6)] + [""] * (rng.random() < 0.1)
        rows.append((i, "\n".join(lines)))
    rows += [(100, ""), (101, "\n\n"), (102, "same line again " * 20 + "\n" + "same line again " * 20), (103, "x " * 30_000)]
    found = line_dedup.cut(spark.createDataFrame(rows, SCHEMA).withColumn("n_removed", F.lit("x"))).collect()
    expected = brute.cut_lines(rows)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in found} == expected


def test_line_cuts_of_nulls_and_repeats(spark):
    text = "a line of words " * 20 + "\nlast"
    rows = [(1, None), (None, text), (2, text), (2, text), (3, "short\n" + text)]
    found = line_dedup.cut(spark.createDataFrame(rows, SCHEMA)).collect()
    by = sorted(((r["doc_id"] or 99), r["text"] or "", r["n_removed"]) for r in found)
    assert by == [(1, "", 0), (2, text, 0), (2, text, 0), (3, "short", 2), (99, "", 2)]
    assert line_dedup.cut(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_stop_at_the_cap():
    wanted = mixing.shares([100, 100, 100, 0], [5, 2, 1, 5], 450, 2)
    assert wanted == pytest.approx([200, 500 / 3, 250 / 3, 0])
    assert mixing.shares([], [], 0, 2) == []
    assert sum(mixing.shares([7, 0, 9], [5, 2, 1], 24, 2)) == pytest.approx(24)


def test_draws_and_permutations():
    slots = [500, 0, 20, 3]
    drawn = mixing.draws(slots, 7, 1)
    assert drawn.sum(axis=0).tolist() == slots and np.ptp(drawn.sum(axis=1)) <= 1
    for size in (1, 2, 3, 10, 257):
        index = np.arange(size)
        made = mixing.permute(index, np.full(size, size), np.full(size, -5))
        assert sorted(made) == list(index)


def check_mix(found, docs):
    sums = docs.groupby("source", dropna=False)["size"].sum()
    total = docs["size"].sum()
    assert found["size"].sum() == total
    order = sorted((s for s in sums.index if pd.notna(s))) + ([None] if sums.index.isna().any() else [])
    size = [int(sums[s]) if s is not None else int(sums[sums.index.isna()].iloc[0]) for s in order]
    wanted = mixing.shares(size, [float((5, 2, 1)[i % 3]) for i in range(len(size))], 1.5 * total, 2)
    for s, n, t in zip(order, size, wanted, strict=True):
        own = found[found.source == s] if s is not None else found[found.source.isna()]
        assert (own.source_size == n).all() and np.allclose(own.target, t)
        assert abs(own.taken.sum() - t) <= 1
    assert (found.taken <= 2 * found["size"]).all()


def test_mix_amounts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    docs["size"] = docs.text.map(lambda t: len(brute.words(t)))
    found = queries.op7_mix_sources(spark, sf_dir).toPandas()
    found["source"] = found.doc_id.map(docs.source)
    check_mix(found, docs)
    again = queries.op7_mix_sources(spark, sf_dir).repartition(3).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_blocks_of_the_mixture(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)  # several shards
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = mixing.packed(docs, block=64).toPandas()
    assert (found.n_words == found.text.map(lambda t: len(t.split(" ")))).all() and not found.duplicated(["source", "slot"]).any()
    amounts = mixing.amounts(docs).toPandas()
    sources = dict(zip(docs.toPandas().doc_id, docs.toPandas().source, strict=True))
    wanted = {s: round(t) for s, t in zip(amounts.doc_id.map(sources), amounts.target, strict=True)}
    assert found.groupby("source").n_words.sum().to_dict() == wanted
    passes = {s: -(-t // n) for s, t, n in zip(amounts.doc_id.map(sources), amounts.target, amounts.source_size, strict=True)}
    assert all((own.n_words < 64).sum() <= passes[s] + 1 for s, own in found.groupby("source"))
    # Shards hold what the draws gave each source, all but the same number of slots each, and runs of words of the source.
    order = sorted(passes)
    sizes = amounts.assign(s=amounts.doc_id.map(sources)).groupby("s").source_size.first()
    slots = [mixing.slot_count(int(sizes[s]), wanted[s], 64) for s in order]
    shards = -(-sum(slots) // 40)
    drawn = mixing.draws(slots, shards, mixing.SEED)
    held = found.groupby(["shard", "source"]).size()
    assert {k: int(n) for k, n in held.items()} == {(i, s): int(drawn[i, j]) for i in range(shards) for j, s in enumerate(order) if drawn[i, j]}
    assert np.ptp(found.groupby("shard").size()) <= 1 and found.shard.nunique() > 3
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.source] |= set(brute.words(r.text))
    assert all(set(t.split(" ")) <= texts[s] for s, t in zip(found.source, found.text, strict=True))


def test_draws_reach_the_result(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 8)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    one = mixing.amounts(docs).toPandas().set_index("doc_id")
    assert one.shards.map(len).max() > 1 and ((one.shards.map(len) > 0) == (one.taken > 0)).all()

    def constant(slots, shards, seed):
        out = np.zeros((shards, len(slots)), np.int64)
        out[0] = slots
        return out

    monkeypatch.setattr(mixing, "draws", constant)
    other = mixing.amounts(docs).toPandas().set_index("doc_id")
    assert (other.taken == one.taken[other.index]).all() and any(list(a) != list(b) for a, b in zip(other.shards, one.shards[other.index], strict=True))


def test_mix_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i if i % 9 else None, "w " * rng.randrange(0, 3000), rng.choice(["a", "b", "é", None, "z"])) for i in range(80)]
    rows += [(1, "same text", "a")] * 3 + [(500, None, "a"), (501, None, "only nulls"), (502, "x " * 40_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    found = mixing.amounts(df).toPandas()
    plain = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    plain["size"] = plain.text.map(lambda t: len(brute.words(t)))
    assert len(found) == len(rows) and (found.taken <= 2 * found["size"]).all()
    by = found.groupby(["source_size", "target"]).agg(size=("size", "sum"), taken=("taken", "sum")).reset_index()
    assert (by["size"] == by.source_size).all() and ((by.taken - by.target).abs() <= 1).all()
    assert by.target.sum() == pytest.approx(1.5 * plain["size"].sum())
    for empty in (df.limit(0), df.where("text is null")):
        assert mixing.amounts(empty).count() == empty.count()
        assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(df.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    known = {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    assert all(set(brute.words(r["text"])) <= set(brute.words(known[r["doc_id"]])) for r in mixed)


def test_pipeline(spark, sf_dir):
    from fleetlake.session import materialize

    docs = load(spark, sf_dir, "documents")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        results[name] = docs.toPandas()
        if name != "byte-level BPE":
            assert docs.columns == corpus_pipeline.COLUMNS
    raw = documents(spark, sf_dir)
    quality = results["quality rules"]
    assert set(quality.doc_id) <= set(raw.index) and not any(brute.quality(t)[-1] for t in quality.text)
    cut = brute.cut_lines(zip(quality.doc_id, quality.text, strict=True))
    lines = results["line dedup"].set_index("doc_id").text
    assert lines.to_dict() == {k: t for k, (t, lost) in cut.items() if not lost or brute.words(t)}
    near = brute.near_groups(lines.items(), corpus_pipeline.SIMILARITY)
    assert set(results["near dedup"].doc_id) == {k for k, (_, c) in near.items() if k == c}
    mixed, before = results["mixing"], results["near dedup"].set_index("doc_id")
    size = before.text.map(lambda t: len(brute.words(t)))
    taken = collections.Counter()
    for r in mixed.itertuples():
        taken[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text) and r.source == before.source[r.doc_id]
    order = sorted(before.source.unique())
    wanted = mixing.shares(
        [int(size[before.source == s].sum()) for s in order], [float((5, 2, 1)[i % 3]) for i in range(len(order))], 1.5 * int(size.sum()), 2
    )
    for s, t in zip(order, wanted, strict=True):
        assert abs(sum(n for k, n in taken.items() if before.source[k] == s) - t) <= 1
    ids = results["byte-level BPE"]
    assert len(ids) == len(mixed) and (ids.n_tokens == ids.ids.map(len)).all()
