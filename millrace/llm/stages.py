"""The operators as steps of a corpus pipeline: documents in, documents (or packed pieces) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import entry, exact_dedup, langid, ngram_join, packing, pii

#: Near copies: words in a shingle, and the similarity in percent that links two texts.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go; a missing label is filled in."""
    return langid.keep_identified(docs, entry.trained(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest identifier stays; rows without one stay."""
    stay = ngram_join.join(docs, n=NEAR_WORDS, percent=NEAR_PERCENT).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; ``n_chars`` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in the training sequences."""
    return packing.pack_documents(docs, entry.vocabulary(), entry.SEQUENCE_TOKENS, entry.END_TOKEN)
