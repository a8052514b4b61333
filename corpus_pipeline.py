"""A corpus pipeline of five of the training-data operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import stages
from millrace.llm._shared import documents, materialize

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language identification", stages.identify_language),
    ("exact dedup", stages.drop_exact_copies),
    ("n-gram Jaccard join", stages.drop_near_copies),
    ("personal data", stages.redact_personal_data),
    ("best-fit packing", stages.pack_sequences),
]

#: The language model, the redaction and the packing can't be told in SQL; a brute-force test stands for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
