"""Queries of the corpus operators over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .byte_cnn import quality_scores
from .exact_dedup import exact_duplicates
from .graph_index import nearest
from .language_id import languages
from .packing import pack_conversations
from .sharding import shard
from .simhash import near_duplicates
from .substring_dedup import without_repeats
from .token_counts import section_tokens
from .vocabulary import read_vocabulary

#: A public vocabulary file; another path may be given here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_docs(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_docs(spark, sf_dir))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows are indexed; those with ids divisible by 100 are the queries."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries="vec_id % 100 = 0")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_docs(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), read_vocabulary(VOCABULARY))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_docs(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_docs(spark, sf_dir), read_vocabulary(VOCABULARY))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_docs(spark, sf_dir), read_vocabulary(VOCABULARY), check=True)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_nearest": op4_nearest,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER g END AS keeper_id,
               CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER g END AS n_copies,
               text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS keep
        FROM documents WINDOW g AS (PARTITION BY text)
    """,
    "op7_substring_dedup": r"""
        WITH parts AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS part,
                   generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS i
            FROM documents),
        lists AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
        windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM lists WHERE len(w) >= 50),
        later AS (
            SELECT doc_id, p
            FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY list_slice(w, p, p + 49) ORDER BY doc_id, p) AS n FROM windows)
            WHERE n > 1),
        marked AS (
            SELECT parts.doc_id, part, i, coalesce(max(p) OVER (PARTITION BY parts.doc_id ORDER BY i) > i - 50, false) AS gone
            FROM parts LEFT JOIN later ON later.doc_id = parts.doc_id AND later.p = parts.i),
        kept AS (
            SELECT doc_id, string_agg(part, '' ORDER BY i) FILTER (NOT gone) AS body, count(*) FILTER (gone) AS n
            FROM marked GROUP BY doc_id)
        SELECT doc_id, CASE WHEN n IS NULL THEN text ELSE coalesce(body, '') || regexp_extract(text, '\s*$') END AS text,
               coalesce(n, 0) AS n_removed
        FROM documents LEFT JOIN kept USING (doc_id)
    """,
}
