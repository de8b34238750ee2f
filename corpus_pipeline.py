"""From raw documents to token ids: identify the language, drop near duplicates, decontaminate, pseudonymise, encode.

Each stage works on all that its predecessor kept. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import bpe, decontaminate, jaccard, language, pii
from sigspark.llm.queries import PII_KEY, VOCABULARY
from sigspark.llm.tables import bounded_batches, freeze, read, remainder
from sigspark.operators.scale import small_side


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those without any letter go. Learns from the documents it is given."""
    bounded_batches(spark)
    return language.keep_identified(docs, remainder("doc_id", 5) != 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are near duplicates: the one of the smallest doc_id. Words five, similarity 0.8.

    Each text is judged by itself: a doc_id's other texts stay if they are like no kept one. Of rows that repeat both
    doc_id and text the first in order of their columns stays. Rows without a doc_id, and texts without words, have no
    duplicates.
    """
    bounded_batches(spark)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    judged = F.col("doc_id").isNotNull() & F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    nodes = docs.where(judged).withColumn("_node", F.xxhash64(doc_id, text))
    groups = jaccard.jaccard_components(nodes.select(F.col("_node").alias("doc_id"), "text"), size=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("_node"), "component_id").distinct()
    counted = nodes.groupBy("_node").agg(F.min(doc_id).alias("_id"), F.count(F.lit(1)).alias("_rows"))
    counted = freeze(counted.join(groups, "_node"))
    kept = counted.groupBy("component_id").agg(F.min(F.struct("_id", "_node")).alias("_kept")).select("_kept._node")
    kept = counted.join(kept.withColumn("_stays", F.lit(True)), "_node", "left")
    # rows of texts that stay and come once pass as they are; the others are few, as a rule
    others = small_side(kept.where("_stays IS NULL OR _rows > 1").select("_node", "_stays"))
    again = nodes.join(others.where("_stays"), "_node", "left_semi").groupBy("_node").agg(
        F.min(F.struct(*docs.columns)).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return nodes.join(others, "_node", "left_anti").select(docs.columns).union(again).union(docs.where(~judged))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bounded_batches(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in ``text`` and ``n_chars`` counted anew."""
    bounded_batches(spark)
    hidden = pii.with_pseudonyms(docs, PII_KEY)
    return hidden.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and their digests."""
    bounded_batches(spark)
    return bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonymise),
    ("bpe", encode),
]
#: The stages learn, search and encode in ways that SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
