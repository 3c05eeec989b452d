"""Words of a UTF-8 text as 64-bit numbers, found and hashed in numpy.

A word is a run of bytes other than the six ASCII white-space characters. Its number depends on its
bytes alone: not on the process, the position, or the white space around it.
"""

from __future__ import annotations

import re

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Splits and hashes; keeps the powers it needs, so make one per task."""

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)
        self._word = np.ones(256, bool)
        self._word[list(SPACES)] = False
        self._next_space = re.compile(rb"[ \t-\r]")

    def _grow(self, n: int) -> None:
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            have = getattr(self, name)
            while len(have) < n:
                step = np.uint64(pow(base, len(have), 1 << 64))
                have = np.concatenate([have, have * step])
            setattr(self, name, have)

    def _pieces(self, data: bytes):
        """Parts of bounded length that end where a word ends."""
        at = 0
        while len(data) - at > _CHUNK:
            found = self._next_space.search(data, at + _CHUNK)
            if found is None:
                break
            yield data[at : found.end()]
            at = found.end()
        yield data[at:] if at else data

    def hashes(self, data: bytes, letters: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """A number per word in order and, if asked for, each word's code points."""
        numbers, lengths = [], []
        for part in self._pieces(data):
            array = np.frombuffer(part, np.uint8)
            mask = np.zeros(len(array) + 2, np.int8)
            mask[1:-1] = self._word[array]
            edges = np.flatnonzero(np.diff(mask))
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            self._grow(len(array) + 1)
            sums = np.zeros(len(array) + 1, np.uint64)
            np.cumsum((array.astype(np.uint64) + np.uint64(1)) * self._powers[: len(array)], out=sums[1:])
            numbers.append(mix64((sums[ends] - sums[starts]) * self._inverses[starts]))
            if letters:
                points = np.zeros(len(array) + 1, np.int64)
                np.cumsum((array & 0xC0) != 0x80, out=points[1:])
                lengths.append(points[ends] - points[starts])
        if not numbers:
            return np.empty(0, np.uint64), np.empty(0, np.int64) if letters else None
        return np.concatenate(numbers), np.concatenate(lengths) if letters else None


def rolling(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` words."""
    out = numbers[: max(len(numbers) - n + 1, 0)].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + numbers[k : k + len(out)]
    return mix64(out)
