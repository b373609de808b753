"""A corpus pipeline over ``documents``: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes the documents that the one before kept.  All but the last
return the columns of documents; the last returns each text's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import byte_bpe, decontaminate, language, near_dup, pii
from loomwork.llm.queries import table, vocabulary
from loomwork.plans import storage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages that the labelled documents show."""
    return language.accepted(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dup.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts kinds in place of personal data; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their digest, and the digest of the bytes they decode to."""
    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("byte_level_bpe", byte_level_bpe)]

#: SQL cannot express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again but for the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
