"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: several iterative-quantisation rotations, learned on a bounded sample of
centred vectors, each give as many bits as the vector has components (at most 64);
their bits together are the code. The search radius is learned on the same sample:
the Hamming distance within which nearly all of its true neighbours lie.

Index: a code is split into substrings of 16 bits, and in every index block a
table for each substring leads from its values to the rows that have them. By the
pigeonhole principle a code within the radius of a query differs from it by at
most radius // substrings bits in one of them at least, so probing all values that
near in every table retrieves every code within the radius; the whole code then
decides, and what is within the radius is ranked by exact distances.

Queries, cut into blocks, meet all rows, cut into blocks: both are of bounded size,
every row is indexed, and each pair of blocks is one group of a shuffle. Queries
for which the radius held fewer than k rows are searched again without one.

Vectors that are null, zero, of another length than most of the sample or hold null
or non-finite components take no part, nor do rows without an id. Rows equal in id
and vector count once; a query is never its own neighbour, nor is another row with
its id. Ties go to the smaller id. With no more than k candidates all are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbledger.llm.common import stored

#: Vectors that the rotations are learned on, and queries among them that the radius is learned on.
SAMPLE, SAMPLE_QUERIES = 10_000, 200
#: Rotations, their iterations; part of the sample's true neighbours that the radius must hold.
ROTATIONS, TURNS, HELD = 4, 20, 0.98
#: Rows in an index block and in a query block, about; bits in a substring; queries probed at a time.
INDEX_ROWS, QUERY_ROWS, BITS, AT_ONCE = 16_384, 2_048, 16, 64
SEED = 11


@dataclass
class Codes:
    mean: np.ndarray
    rotations: np.ndarray  # components x bits
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings for each vector."""
        bits = (x - self.mean) @ self.rotations > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % BITS)))
        return np.packbits(bits, axis=1).view(np.uint16)


def rotated(x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """A rotation that brings centred vectors near to the corners of the cube."""
    n = x.shape[1]
    turn = np.linalg.qr(r.normal(size=(n, n)))[0]
    for _ in range(TURNS):
        u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
        turn = (u @ v).T
    return turn


def learned(sample: np.ndarray, k: int) -> Codes:
    """Rotations and radius from sample vectors."""
    r = np.random.default_rng(SEED)
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    x = sample - mean
    # on differently chosen parts, so that the rotations differ in more than their start
    parts = [x[r.permutation(len(x))[: max(len(x) // 2, min(len(x), 500))]] for _ in range(ROTATIONS)]
    codes = Codes(mean, np.hstack([rotated(p, r) for p in parts]) if len(x) else np.zeros((x.shape[1], x.shape[1] * ROTATIONS)), 0)
    found, of = [], codes.of(sample)
    for q in range(min(SAMPLE_QUERIES, len(x))):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1))[:k] if len(d) > k else np.flatnonzero(np.isfinite(d))
        found.append(np.bitwise_count(of[near] ^ of[q]).sum(1))
    codes.radius = int(np.quantile(np.concatenate(found), HELD)) if found and len(np.concatenate(found)) else codes.rotations.shape[1]
    return codes


class Index:
    """The substring tables of some rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable").astype(np.int32)
            values, begin = np.unique(column[order], return_index=True)
            self.tables.append((order, values, np.append(begin, len(order))))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For each query code, the places of all rows within the radius."""
        near = radius // self.codes.shape[1]
        for query in queries:
            hit = np.zeros(len(self.codes), bool)
            for (order, values, begin), part in zip(self.tables, query):
                for b in np.flatnonzero(np.bitwise_count(values ^ part) <= near) if near < 4 else ():
                    hit[order[begin[b] : begin[b + 1]]] = True
                if near >= 4:  # most values are near: one pass over the table marks them together
                    hit[order] |= np.repeat(np.bitwise_count(values ^ part) <= near, np.diff(begin))
            rows = np.flatnonzero(hit)
            yield rows[np.bitwise_count(self.codes[rows] ^ query).sum(1) <= radius]


def usable(vectors: DataFrame, length: int | None = None) -> Column:
    """Which rows take part."""
    v = F.col("embedding")
    fits = F.size(v) == length if length is not None else F.size(v) > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & v.isNotNull() & fits & finite & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest rows found, nearest first."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asked"))
    sample = rows.filter(usable(rows)).select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    lengths = [len(row[0]) for row in sample]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    codes = learned(np.array([row[0] for row in sample if len(row[0]) == length], dtype=np.float64).reshape(-1, length), k)
    rows = stored(rows.filter(usable(rows, length)).dropDuplicates(["vec_id", "embedding"]), "vectors")
    queries = stored(rows.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "queries")
    first = searched(rows, queries, codes, codes.radius, k)
    first = stored(first, "found")
    n = F.count(F.lit(1)).alias("n")
    few = queries.join(first.groupBy("query_id").agg(n).filter(F.col("n") >= k), "query_id", "left_anti")
    again = searched(rows, stored(few, "queries"), codes, codes.rotations.shape[1], k)
    return first.join(few.select("query_id").distinct(), "query_id", "left_anti").union(again)


def searched(rows: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    """The k nearest within a Hamming radius."""
    n_rows, n_queries = rows.count(), queries.count()
    index_blocks, query_blocks = max(1, -(-n_rows // INDEX_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "query", at("query_id", query_blocks).alias("q")).withColumn("i", every(index_blocks))
    right = rows.select("vec_id", "embedding", at("vec_id", index_blocks).alias("i")).withColumn("q", every(query_blocks))

    def search(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(known):
            x = np.array(known["embedding"].tolist(), dtype=np.float64)
            y = np.array(asked["query"].tolist(), dtype=np.float64)
            ids = known["vec_id"].to_numpy()
            index = Index(codes.of(x))
            for query_id, q, places in zip(asked["query_id"].to_numpy(), y, index.within(codes.of(y), radius)):
                places = places[ids[places] != query_id]
                d = np.sqrt(((x[places] - q) ** 2).sum(1))
                best = np.lexsort((ids[places], d))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[places][best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
