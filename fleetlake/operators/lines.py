"""Ordered differences of texts, line by line.

The lines kept are a longest common subsequence. It is found for a whole line of one text at a time, with one bit per line of
the other (whole numbers of Python are as long as they need to be), so a pair takes n * m / 64 steps; the lines that both texts
begin and end with are set aside first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_edits(old: Sequence[str], new: Sequence[str]) -> list[tuple[str, str]]:
    """(sign, line) in order: kept (blank), removed (-) and added (+); at one place removals come first."""
    ahead = 0
    while ahead < min(len(old), len(new)) and old[ahead] == new[ahead]:
        ahead += 1
    tail = 0
    while tail < min(len(old), len(new)) - ahead and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[ahead : len(old) - tail], new[ahead : len(new) - tail]
    holds: dict[str, int] = {}
    for j, line in enumerate(b):
        holds[line] = holds.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    # A zero at place j of a row: with the lines of ``a`` so far, the subsequence of b's first j + 1 lines is longer than that of its first j.
    rows = [full]
    for line in a:
        row, here = rows[-1], holds.get(line, 0)
        match = row & here
        rows.append(((row + match) | (row & ~here)) & full)
    middle: list[tuple[str, str]] = []
    i, j = len(a), len(b)
    while i or j:
        if j and (not i or rows[i] >> (j - 1) & 1):
            j -= 1
            middle.append(("+", b[j]))
        elif not j or not rows[i - 1] >> (j - 1) & 1:
            i -= 1
            middle.append(("-", a[i]))
        else:
            i, j = i - 1, j - 1
            middle.append((" ", a[i]))
    middle.reverse()
    out, removed, added = [(" ", x) for x in old[:ahead]], [], []
    for sign, line in [*middle, (" ", None)]:
        if sign == "-":
            removed.append((sign, line))
        elif sign == "+":
            added.append((sign, line))
        else:
            out += [*removed, *added] if line is None else [*removed, *added, (sign, line)]
            removed, added = [], []
    return out + [(" ", x) for x in old[len(old) - tail :]]


def with_line_edits(pairs: DataFrame, old: Column, new: Column, into: str = "edits") -> DataFrame:
    """``pairs`` with the edits from ``old`` to ``new``, an array of (sign, line). A null text has no line."""

    @F.arrow_udf("array<struct<sign:string,line:string>>")
    def edits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("sign", pa.string()), ("line", pa.string())]))
        for olds, news in batches:
            texts = [[[] if t is None else t.split("\n") for t in side.to_pylist()] for side in (olds, news)]
            made = [[{"sign": s, "line": x} for s, x in line_edits(a, b)] for a, b in zip(*texts, strict=True)]
            yield pa.array(made, kind)

    return pairs.withColumn(into, edits(old, new))
