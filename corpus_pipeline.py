"""From raw documents to token ids: stages that each write Parquet and read it for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbledger.llm import bpe, mixing, near_dup, pii, quality_mil
from ebbledger.llm.common import labelled, stored, table
from ebbledger.llm.queries import BPE_FILE

#: Documents under this score are rejected.
LEAST_QUALITY = 0.7
#: Most passes through a source in the mixture.
REPETITIONS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from all labels, accepts. It is applied to each row's own text."""
    model = quality_mil.learn(labelled(docs, table(spark, sf_dir, "labels"), "quality", quality_mil.FIT_DOCS))
    return quality_mil.accepted(docs, model, LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    return near_dup.deduplicated(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their source wants, each once at least."""
    plan = mixing.planned(docs, repetitions=REPETITIONS)
    return mixing.mixed(docs, plan, numbered=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids, and digest of the text decoded from them, for each row."""
    return bpe.digests(bpe.round_trip(docs, BPE_FILE))


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: SQL cannot express the stages; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "pipeline")
    return docs
