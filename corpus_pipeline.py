"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Every stage but the last returns the columns of ``docs`` whatever they are; it needs ``doc_id`` and ``text`` alone. An empty
table stays empty. Very long texts are read whole by every stage, as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.byte_cnn import keep_good
from loomgraph.llm.common import materialise
from loomgraph.llm.exact_dedup import drop_exact_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.queries import VOCABULARY
from loomgraph.llm.simhash import drop_near_duplicates
from loomgraph.llm.substring_dedup import drop_repeats
from loomgraph.llm.vocabulary import read_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject. Null and empty texts go; repeated rows are judged alike."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, the least doc_id (nulls last); null texts all stay. Of repeated rows one stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of all pairs of near copies, the least doc_id (nulls last); texts without a word all stay."""
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; null texts, and documents of which no word is left, go.

    ``n_chars``, if there is such a column, is counted anew.
    """
    cut = drop_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.filter(F.col("text").rlike(r"\S"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each document that is left; a null text counts its separator alone, and repeated rows are packed each."""
    return pack_documents(docs, read_vocabulary(VOCABULARY))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substring", passages), ("packing", packed)]

#: SQL can express neither the classifier nor the packing; ``tests/llm`` hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
