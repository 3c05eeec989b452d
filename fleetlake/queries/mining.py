"""Common substrings and compression dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining as Z
from ..plans import dictionary as D
from ..registry import query
from ..session import load, scratch
from ..sinks import files as W


@query("turn_pairs", "SELECT a.conv_id, a.turn, a.role AS asker, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def turn_pairs(spark, d):
    return D.turn_pairs(load(spark, d, "conversations"))


@query("common_substrings")
def common_substrings(spark, d):
    return Z.mine_pairs(D.turn_pairs(load(spark, d, "conversations")), "a", "b", ["conv_id", "turn"])


@query(
    "substring_freqs",
    "SELECT w AS substr, count(*) AS freq FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1 ORDER BY freq DESC, substr",
)
def substring_freqs(spark, d):
    """In how many documents each word occurs, most frequent first."""
    words = load(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", " "))).alias("substr"))
    return Z.freqs_descending(Z.substring_freq(words))


@query(
    "substring_freq",
    """SELECT lang, w AS substr, count(*) AS freq FROM (SELECT DISTINCT doc_id, lang, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY 1, 2""",
)
def substring_freq(spark, d):
    doc = load(spark, d, "documents")
    words = doc.select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("substr"))
    return Z.substring_freq(words, ["lang"])


@query("mined_freqs_descending")
def mined_freqs_descending(spark, d):
    """In how many turn pairs each mined substring is common, most frequent first."""
    return Z.freqs_descending(D.mined_freqs(load(spark, d, "conversations")))


@query("written_mined_freqs")
def written_mined_freqs(spark, d):
    """The same, written as JSON lines and read back."""
    path = scratch(spark, "mined-freqs")
    W.write_freqs(D.mined_freqs(load(spark, d, "conversations")), path)
    return spark.read.schema("substr string, freq long").json(path)


@query("swallowed_scores")
def swallowed_scores(spark, d):
    return Z.swallow(D.mined_freqs(load(spark, d, "conversations"))).drop("id")


@query("build_dictionary")
def build_dictionary(spark, d):
    """One dictionary per asking role."""
    pairs = D.turn_pairs(load(spark, d, "conversations"))
    return D.dictionary_of_pairs(pairs, "a", "b", 4096, ["asker"])
