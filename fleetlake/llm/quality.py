"""Quality rules by repetition coverage.

Rolling hashes of the word runs of several lengths, in numpy, find the runs that occur twice or more
in a text; the share of a text's letters that lie inside them, and inside repeated lines, decides. A
share of symbols per word completes the rules. Every text is read whole and judged by itself: there
is no shuffle, and a task holds one Arrow batch.

Defined cases: a null text is an empty one and fails (no words). Rows that repeat are judged each for
itself. Extra columns are kept; a column with the result's name is replaced. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACES, Words, rolling

#: Word runs, with the share of letters inside repeated ones from which a text is rejected.
COVERAGE = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: The same for lines equal to an earlier one.
LINE_COVERAGE = 0.30
#: Symbols per word from which a text is rejected.
SYMBOLS_PER_WORD = 0.25
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
BASE_RUN, BASE_SHARE = 8, 30

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_run_share array<double>, base_failed boolean, kept boolean"
)


def _covered(numbers: np.ndarray, n: int, n_words: int) -> np.ndarray | None:
    """Which words lie in a run of ``n`` that occurs twice or more; None if no run does."""
    runs = rolling(numbers, n)
    ordered = np.sort(runs)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return None
    starts = np.flatnonzero(np.isin(runs, twice))
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(words: Words, data: bytes, coverage=None, line_coverage=LINE_COVERAGE, symbols_per_word=SYMBOLS_PER_WORD) -> tuple:
    """The measures of one text, in the order of ``MEASURES``."""
    coverage = COVERAGE if coverage is None else coverage
    numbers, lengths = words.hashes(data, letters=True)
    n_words, word_chars = len(numbers), int(lengths.sum())
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines = dup_chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_chars += len(line.translate(None, SPACES).decode("utf-8", "replace"))
        elif line.strip(SPACES):
            seen.add(line)
    shares, n_repeat, repeats = [], 0, True
    for n in sorted({*coverage, BASE_RUN}):
        # A longer run that repeats holds shorter ones that do.
        covered = _covered(numbers, n, n_words) if repeats else None
        repeats = covered is not None
        if n == BASE_RUN:
            n_repeat = int(covered.sum()) if repeats else 0
        if n in coverage:
            shares.append(float(lengths[covered].sum()) / word_chars if repeats else 0.0)
    line_share = dup_chars / word_chars if word_chars else 0.0
    failed = n_words < MIN_WORDS or 100 * n_repeat > BASE_SHARE * n_words
    kept = not (
        failed
        or line_share > line_coverage
        or any(share > coverage[n] for n, share in zip(sorted(coverage), shares, strict=True))
        or n_symbols > symbols_per_word * n_words
    )
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, line_share, shares, failed, kept


def judge(
    docs: DataFrame,
    text: str = "text",
    into: str = "quality",
    coverage: dict[int, float] | None = None,
    line_coverage: float = LINE_COVERAGE,
    symbols_per_word: float = SYMBOLS_PER_WORD,
) -> DataFrame:
    """``docs`` with a struct ``into`` of ``MEASURES``; ``kept`` is the verdict."""
    limits = dict(COVERAGE if coverage is None else coverage)

    @F.arrow_udf(f"struct<{MEASURES.replace(' long', ':long').replace(' double', ':double').replace(' array', ':array').replace(' boolean', ':boolean')}>")
    def measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
        names = [part.split()[0] for part in MEASURES.split(", ")]
        for batch in batches:
            rows = [measure(words, value.as_py() or b"", limits, line_coverage, symbols_per_word) for value in batch]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.withColumn(into, measures(F.col(text).cast("binary")))
