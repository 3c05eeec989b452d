"""Plain restatements of the operators, on small inputs."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if runs[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def base_spans(text):
    text = text or ""
    assign = re.compile(
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A
    )
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows, similarity=85):
    """doc_id -> (set size, smallest id of its group) of (doc_id, text)."""
    sets = {key: shingles(text) for key, text in rows}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(set)
    for key, own in sets.items():
        shared = collections.Counter()
        for s in own:
            shared.update(holders[s])
            holders[s].add(key)
        for other, n in shared.items():
            if 100 * n >= similarity * (len(own) + len(sets[other]) - n):
                a, b = sorted((find(key), find(other)))
                root[b] = a
    return {key: (len(own), find(key)) for key, own in sets.items()}


def cut_lines(rows, least=50):
    """doc_id -> (text less later repeats, lines deleted) of (doc_id, text), ordered by id."""
    found, first = {}, {}
    for key, text in sorted(rows):
        lines = text.split("\n")
        size = [len(words(line)) for line in lines]
        own = [k for k in range(len(lines)) if size[k]]
        spans = set()
        for a in range(len(own)):
            for step, stop in ((1, len(own)), (-1, -1)):
                total = 0
                for b in range(a, stop, step):
                    total += size[own[b]]
                    if total >= least:
                        low, high = min(a, b), max(a, b)
                        spans.add((own[low], own[high], tuple(lines[own[k]] for k in range(low, high + 1))))
                        break
        for i, j, content in spans:
            place = (key, i, j)
            first[content] = min(first.get(content, place), place)
        found[key] = lines, spans
    out = {}
    for key, (lines, spans) in found.items():
        gone = {k for i, j, c in spans if (key, i, j) > first[c] for k in range(i, j + 1)}
        out[key] = "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)
    return out
