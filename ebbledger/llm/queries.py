"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbledger.llm import bpe, hamming_ann, langid, lexical, mixing, near_dup, packing, pii, quality_mil, quality_rules, suffix_dedup, toxicity, whitening
from ebbledger.llm.common import fold, labelled, stored, table

#: Vocabulary of the BPE query.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def held_out(condition: Column) -> Column:
    """A row without an id is in no fold: it is neither learned from nor held out."""
    return F.coalesce(condition, F.lit(False)).alias("held_out")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), BPE_FILE))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(quality_rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = quality_rules.learn(measured.join(labels, "doc_id"))
    failed = quality_rules.base_failed()
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & quality_rules.verdict(rules)).alias("kept"), quality_rules.fired(rules).alias("rule"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"), length=400)
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4)
    model = quality_mil.learn(labelled(docs, labels.filter(part != 2), "quality", quality_mil.FIT_DOCS))
    scored = quality_mil.score(docs, model)
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(part == 2), "score", predicted, "n_passages", "top_passage", "top_weight")


def op5_hamming_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5)
    lexicon = toxicity.learn(labelled(docs, labels.filter(part != 0), "toxic", toxicity.LEARN_DOCS))
    scored = toxicity.score(docs, lexicon)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(part == 0), "score", predicted, "n_matches")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.planned(docs)
    return mixing.mixed(docs.select("doc_id", "source"), plan).withColumnsRenamed({"_epoch": "epoch", "_block": "block"})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = fold(F.col("doc_id"), 5)
    known = langid.dictionaries(docs.filter(part != 0))
    return langid.identify(docs, known).select("doc_id", held_out(part == 0), "lang_pred", "score", "rejected")


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_FILE)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_bpe": op4_bpe,
    "op5_hamming_ann": op5_hamming_ann,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_minhash_near_dup": op9_minhash_near_dup,
    "op10_pii": op10_pii,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE = {"op7_mixing": mixing.oracle_sql(), "op13_lexical_search": lexical.oracle_sql(k=10)}
