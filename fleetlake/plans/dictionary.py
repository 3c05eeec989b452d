"""Compression dictionaries from pairs of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mining import build_dictionary, mine_pairs, substring_freq
from ..session import materialize


def turn_pairs(conversations: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Each turn with the next one: (conv_id, turn, asker, a, b); a role named limits its side.

    Joined on conversation and turn number together, so a long conversation is spread out.
    """
    a = conversations.select("conv_id", "turn", F.col("role").alias("asker"), F.col("text").alias("a"))
    b = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("__role"), F.col("text").alias("b"))
    a = a.where(F.col("asker") == first) if first else a
    b = b.where(F.col("__role") == second) if second else b
    return a.join(b.drop("__role"), ["conv_id", "turn"])


def mined_freqs(conversations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frequencies of the substrings common to question and answer."""
    return substring_freq(mine_pairs(turn_pairs(conversations), "a", "b", keys), keys)


def dictionary_of_pairs(pairs: DataFrame, a: str, b: str, size: int, group: Sequence[str] = ()) -> DataFrame:
    """Mine the pairs, count, and build one dictionary per group.

    The frequencies are written once, since building reads them repeatedly and mining is costly.
    """
    freqs = materialize(substring_freq(mine_pairs(pairs, a, b, group), group), "freqs")
    return build_dictionary(freqs, size, group)
