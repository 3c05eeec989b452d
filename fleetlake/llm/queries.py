"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import load
from . import bpe, chat, html, language, line_dedup, mixing, near_dedup, negatives, quality, ranked, secret_scan, simhash, vectors


def ranks_path() -> str:
    """The many-language byte-level ranks; the tokenizer files are a parameter, not a part of this library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    """The pattern that goes with the ranks."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(load(spark, d, "documents").select("doc_id", "text"), whole=True)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.render(F.col("base")), 256).alias("base_sha256"),
        secret_scan.render(F.col("spans")).alias("spans"),
    )


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    path = ranks_path()
    encoded = bpe.encode(docs, path, split_pattern()).select("doc_id", "ids")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS place, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS trained,
         length(text) + length(role) + 24
           + len(regexp_extract_all(text, '(<)(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])')) AS written
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), counted AS (
  SELECT *, sum(trained) OVER (PARTITION BY conv_id ORDER BY place DESC) AS replies,
         last_value(trained) OVER (PARTITION BY conv_id ORDER BY place
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closed
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(CASE WHEN trained = 1 THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN trained = 1 THEN text END, '' ORDER BY place), '')) AS loss_sha256,
       sum(written * (replies + 1 - closed))::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id
"""


@query("op3_chat_format", CHAT_SQL)
def op3_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    made = chat.examples(turns.union(more)).withColumn(
        "reply", F.struct("example", chat.masked(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("t"))
    )
    whole = made.groupBy("conv_id").agg(
        chat.read_back(F.max_by("formatted", "example")).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["t"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op4_nearest_vectors")
def op4_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, F.col("vec_id") % 100 == 0, k=10)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = load(spark, d, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs.drop("lang"), model).select(
        "doc_id",
        "held_out",
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return line_dedup.cut(docs).select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.amounts(load(spark, d, "documents").select("doc_id", "text", "source"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", "quality.*")


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return near_dedup.groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_html_main_text")
def op10_html_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "pages").select("page_id", "url", "html")
    return html.extract(pages).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


RANKED_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), length AS (
  SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), m AS (
  SELECT doc_id, 10 + (90 * n * (SELECT count(*) FROM length)) // (SELECT sum(n)::BIGINT FROM length) AS m FROM length
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM terms SEMI JOIN asked USING (term) GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * (SELECT count(*) FROM length) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return ranked.search(docs, load(spark, d, "benchmark").select("item_id", "text"), k=10)


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label)


@query("op13_simhash_groups")
def op13_simhash_groups(spark: SparkSession, d: str) -> DataFrame:
    return simhash.groups(load(spark, d, "documents").select("doc_id", "text"))
