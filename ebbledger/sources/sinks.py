"""Writing tables: replaced as a whole, and intermediate results in the shared folder."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def by_day(df: DataFrame) -> DataFrame:
    """Rows of a day together, in files of the advisory size; a large day is split over several tasks."""
    return df.hint("rebalance", F.col("date"))


def _reads(df: DataFrame, path: str) -> bool:
    """Whether the frame scans files below the path."""
    root = path.removeprefix("file:").rstrip("/") + "/"
    return any(root in f"{unquote(file)}/".replace("file://", "") for file in df.inputFiles())


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Replaces the table, partitioned by date, and returns a scan of it. A frame that reads the table itself is refused."""
    if _reads(df, path):
        raise ValueError(f"the frame reads {path}, which replacing would destroy")
    by_day(df).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(path)
    return read_table(df.sparkSession, path, df)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A scan of a stored table, in the column order of the frame it was written from."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
