"""Connected components of an edge table, by alternating large-star and small-star steps.

Nothing is collected: each step is a minimum per node and a join back, and only
two numbers per round reach the driver, to see whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def jumped(parents: DataFrame) -> DataFrame:
    """key, root from one smaller parent for each key: pointers are doubled until none moves."""
    now = stored(parents.select("key", F.col("parent").alias("root")), "pointers")
    while True:
        further = now.select(F.col("key").alias("root"), F.col("root").alias("further"))
        moved = now.join(further, "root", "left").select("key", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        now = stored(moved, "pointers")
        if not now.agg(F.count_if("moved")).first()[0]:
            return now.select("key", "root")
        now = now.select("key", "root")


def components(edges: DataFrame) -> DataFrame:
    """key, root of every node that has an edge to another node in edges (a, b); root is the least key it reaches."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("key"), F.col("b").alias("root")).union(now.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
