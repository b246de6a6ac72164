"""What the corpus operators share: reading tables, storing intermediate results, folds, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbledger.sources.sinks import new_path

#: A word of the contracts: a run of anything but the six ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, parts: int) -> Column:
    """The remainder of crc32 of the key as text; a null key has none."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone: whatever else a table carries cannot clash."""
    return docs.select("doc_id", "text", *more)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and one label of at most `most` labelled rows, the first in the order of a hash of their ids.

    The labels sampled are bounded, so they are broadcast and no text is shuffled.
    Rows without id or label drop out; a document with several labels comes several times.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).filter(f"doc_id is not null and {label} is not null")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(most)
    return text_rows(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(sample), "doc_id")
