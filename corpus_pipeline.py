"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last adds copy, the number
of the row among those of its document); run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringspark.llm import decontam, line_crf, mixing, near_text, pii
from ringspark.llm.common import save, table

#: A document of a lower score is rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line classifier, trained on their labels, accepts."""
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(line_crf.scorer(spark, model)("text") >= QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash groups, and a Jaccard similarity of 0.8 or more of five-word shingles."""
    return near_text.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return pii.in_texts(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.take(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pseudonyms), ("mix", mixture)]

#: SQL can't express the fitted classifier, the permutations or the sample; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
