"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .line_dedup import dedup_lines
from .lm_scoring import score_documents
from .mixing import mix_sources
from .ngram_join import link_documents
from .piece_encoding import encode_digests
from .sharding import shard_documents
from .quality_rules import judge_quality
from .topk_search import search
from .toxicity import score_toxicity, train
from .token_counts import count_tokens

PIECE_MODEL = "piece_bpe_32k.model"


def model_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard_documents(read(spark, sf_dir, "documents"), 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: those of ids whose crc32, modulo 5, is not 0."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, training_labels(read(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return got.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.octet_length(text).alias("n_bytes"), F.crc32(text).alias("text_crc32"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


TOPK_SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = count_tokens(read(spark, sf_dir, "documents"), model_path())
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), model_path())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(read(spark, sf_dir, "documents"), held_out)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_topk_search": op4_topk_search,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_piece_encoding": op7_piece_encoding,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_join": op10_ngram_join,
}
ORACLES = {"op4_topk_search": TOPK_SQL}
