"""A training corpus from raw documents: quality rules, line dedup, near dedup, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; ``run`` writes
each result as Parquet in the shared folder and reads it back for the next, and then deletes what the
stage left there. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fleetlake.llm.queries as operators
from fleetlake.llm import bpe, line_dedup, mixing, near_dedup, quality
from fleetlake.registry import query
from fleetlake.session import load, mark, release, scratch

#: Hundredths from which on the stage links near-duplicates; the query op9 has its own, 85.
SIMILARITY = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` that fit the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return docs.transform(quality.judge).where("quality.kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so does a document of which nothing is left."""
    left = line_dedup.cut(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(mixing.WORD)
    return _documents(left.where(~F.coalesce(emptied, F.lit(False))))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.dedup(docs.select(*COLUMNS), similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes: a row per document and pass over its source."""
    return _documents(mixing.mix(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    made = bpe.encode(docs.select(*COLUMNS), operators.ranks_path(), operators.split_pattern())
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]
#: SQL cannot express hashing, merging and draws of the stages; tests compare with brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = load(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)
