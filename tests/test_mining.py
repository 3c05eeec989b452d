"""Common substrings and dictionaries against slow, literal versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlake.functions.hosts import pair_identity
from fleetlake.operators import mining as Z


def slow_longest(data, pos):
    best = ""
    for length in range(3, min(257, len(data) - pos) + 1):
        piece = data[pos : pos + length]
        for start in range(max(0, pos - 32506), pos):
            if all(data[start + i] == piece[i] for i in range(length)):
                best = piece
                break
    return best


def slow_walk(text, known):
    data, pos, found = known + text, len(known), set()
    while pos < len(data):
        best = slow_longest(data, pos)
        if best:
            found.add(best)
        pos += len(best) or 1
    return found


@pytest.mark.parametrize("short", [0, 4096])
def test_walk_equals_slow_walk(monkeypatch, short):
    monkeypatch.setattr(Z, "SHORT", short)
    rng = random.Random(11)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert Z._walk(a, b) == slow_walk(a, b)


def test_places_that_cannot_match_are_not_compared():
    """Texts without repeats compare nothing, at any size; few repeats cost in proportion to the text."""
    def compared(text):
        places = Z._Places(text)
        for pos in range(len(text)):
            places.longest(pos)
        return places.compared

    alphabet = [chr(0x4E00 + i) for i in range(20000)]
    assert compared("".join(alphabet)) == 0
    small, large = ("".join(alphabet[: 1200 * n]) + "".join("".join(alphabet[k : k + 3]) + "." for k in range(0, 300 * n, 3)) for n in (4, 16))
    assert 0 < compared(small) and compared(large) <= 4.2 * compared(small)


def test_the_window_ends():
    far = "needle-in-hay" + "".join(chr(0x4E00 + i % 20000) for i in range(Z.WINDOW - 13))
    assert "needle-in-hay" in Z._walk("needle-in-hay", far)
    assert "needle-in-hay" not in Z._walk("needle-in-hay", far[:13] + "!" + far[13:])


def test_mined_freqs_of_all_pairs(spark, sf_dir):
    import collections

    from fleetlake.queries import mining as Q
    from fleetlake.session import load

    turns = {(r.conv_id, r.turn): r.text for r in load(spark, sf_dir, "conversations").collect()}
    counts = collections.Counter()
    for (conv, turn), b in turns.items():
        a = turns.get((conv, turn - 1))
        if a is not None and b is not None and len(a) + len(b) < 250:  # the slow walk is slow
            counts.update(slow_walk(a, b) & slow_walk(b, a))
    short = load(spark, sf_dir, "conversations")
    pairs = Q.D.turn_pairs(short).where(F.length("a") + F.length("b") < 250)
    found = Z.freqs_descending(Z.substring_freq(Z.mine_pairs(pairs, "a", "b"))).collect()
    assert [(r.substr, r.freq) for r in found] == sorted(counts.items(), key=lambda x: (-x[1], x[0])) and found
    whole = {r.substr: r.freq for r in Q.mined_freqs_descending(spark, sf_dir).collect()}
    assert {r.substr: r.freq for r in Q.written_mined_freqs(spark, sf_dir).collect()} == whole and all(whole[k] >= n for k, n in counts.items())


def test_containments_of_keys_of_all_lengths(spark):
    rng = random.Random(4)
    keys = {"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 6, 7, 15, 16, 17, 40]))) for _ in range(300)}
    keys |= {k[i : i + n] for k in list(keys)[:60] for i, n in ((0, 3), (2, 6), (1, 16)) if len(k) > n}
    rows = [(g, k, i) for i, (g, k) in enumerate((g, k) for g in ("x", "y") for k in sorted(keys) if g == "x" or len(k) % 2)]
    found = {(r.id, r.holder) for r in Z._containments(spark.createDataFrame(rows, "g string, key string, id long"), ["g"]).collect()}
    assert found == {(i, j) for g, k, i in rows for h, m, j in rows if g == h and len(k) < len(m) and k in m}


def test_match_length_limits():
    assert max(map(len, Z._walk("a" * 600, ""))) == 257
    assert Z._walk("abab", "") == set()


def test_common_substrings(spark):
    rows = [("lorem ipsum dolor sit amet", "sit amet consectetur lorem"), ("abcabcabc", "xyz"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(Z.common_substrings("a", "b")).collect()]
    assert got[0] == sorted(slow_walk(*rows[0]) & slow_walk(rows[0][1], rows[0][0]))
    assert "lorem" in got[0] and got[1] == [] and got[2] == []


def test_identity(spark):
    row = spark.range(1).select(pair_identity(F.lit("Pamplemousse"), F.lit("LaCroix"))).first()
    assert row[0] == "259dabbf4c050b3db874eb00d2a5dabb"


PETS = {"corgi": 10, "cat": 5, "lizard": 6, "gecko": 7, "hamster": 4, "parrot": 3}


def frame(spark, freqs):
    return spark.createDataFrame(list(freqs.items()), "substr string, freq long")


@pytest.mark.parametrize(
    "freqs, size, wanted",
    [
        (PETS, 1000, "catparrothamstergeckolizardcorgi"),
        (PETS, 16, "geckolizardcorgi"),
        (PETS, 18, "ergeckolizardcorgi"),
        ({"corgi": 10, "corgicat": 5}, 100, "corgicat"),
    ],
)
def test_known_dictionaries(spark, freqs, size, wanted):
    assert Z.build_dictionary(frame(spark, freqs), size).first()["dictionary"] == wanted


def test_unlimited_entries(spark):
    entries = Z.dictionary_entries(frame(spark, PETS), -1).orderBy(F.col("tail").desc()).collect()
    assert "".join(e.key for e in entries) == "catparrothamstergeckolizardcorgi"
    with pytest.raises(ValueError):
        Z.build_dictionary(frame(spark, PETS), 0)


def slow_swallow(freqs):
    """One key after the other: length, then frequency downwards, then text."""
    order = sorted(freqs, key=lambda k: (len(k), -freqs[k], k))
    score = {k: len(k) * freqs[k] for k in order}
    for i, key in enumerate(order):
        holders = [(-score[h], j) for j, h in enumerate(order) if j > i and key in h and len(h) > len(key)]
        if holders:
            score[order[min(holders)[1]]] += score[key]
            score[key] = 0
    return {k: s for k, s in score.items() if s}


def test_swallow_equals_sequential(spark):
    rng = random.Random(2)
    groups, rows = {}, []
    for g in range(6):
        freqs = {}
        for _ in range(60):
            freqs["".join(rng.choice("ab") for _ in range(rng.randint(1, 7)))] = rng.randint(1, 9)
        groups[g] = freqs
        rows += [(g, k, f) for k, f in freqs.items()]
    df = spark.createDataFrame(rows, "g int, substr string, freq long")
    got = {}
    for r in Z.swallow(df, ["g"]).collect():
        got.setdefault(r.g, {})[r.key] = r.score
    assert got == {g: slow_swallow(f) for g, f in groups.items()}


def test_dictionary_per_group_is_the_cut_of_the_whole(spark):
    rng = random.Random(8)
    rows = [(g, "".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))), rng.randint(1, 4)) for g in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, substr string, freq long").groupBy("g", "substr").agg(F.max("freq").alias("freq"))
    whole = {}
    for e in Z.dictionary_entries(df, 0, ["g"]).orderBy("g", F.col("tail").desc()).collect():
        whole[e.g] = whole.get(e.g, "") + e.key
    for r in Z.build_dictionary(df, 50, ["g"]).collect():
        assert r.dictionary == whole[r.g][-50:]
