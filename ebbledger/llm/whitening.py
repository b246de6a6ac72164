"""Embedding whitening from exact integer cross-products, counted on bit planes.

A vector's entries become whole numbers, floor(64 c) + 1000000. The distinct ones
are the fit list. A block of them is shifted to start at zero in each dimension,
cut into bit planes, and each plane packed across the rows into 64-bit words: the
cross-product of two dimensions is the sum, over pairs of their planes, of the
number of ones both words share, times the planes' weights. Blocks return whole
numbers, sums of whole numbers do not depend on their order, and the scatter
n XX' - SS' is centred as whole numbers before it is turned into doubles.

Left out: vectors that are null, empty, or hold null or non-finite entries, and
vectors of another length than the most common one (the longer, if two are as
common). Entries beyond 64 bits are held at their ends. Repeated rows are kept,
each with its own result, and count once in the fit. Components without variance,
or with none that doubles can tell beside the largest, are not returned: a table of
one distinct vector has none, an empty table no rows.
A deviation beyond 64 bits is null. Columns other than vec_id and embedding play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger.llm.common import stored

#: Fixed: how entries become whole numbers, and the components asked for.
SCALE, BASE, COMPONENTS = 64, 1_000_000, 16
#: Rows whose planes are multiplied together; a multiple of 64.
BLOCK = 4096
#: Bits of a whole number that travel in one 64-bit sum, which has room for 2^31 blocks.
LIMB = 32
#: Words of the planes of two dimensions that are held at once.
HELD = 1 << 21

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# -- whole numbers ------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, as doubles, of the rows that take part."""
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    largest = 1.7976931348623157e308
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c) <= largest, F.lit(False)))
    held = held.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    lengths = held.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()  # one row
    return held.filter(F.size("embedding") == (usual["length"] if usual else -1))


def whole(embedding="embedding"):
    """Entries as whole numbers less BASE, which no centred figure depends on."""
    return F.transform(embedding, lambda c: F.floor(c * SCALE).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


# -- scatter ------------------------------------------------------------------


def planes(x: np.ndarray) -> list[np.ndarray]:
    """Per dimension, its bit planes, lowest first, packed across the rows into words. Entries are not below zero."""
    rows = -(-len(x) // 64) * 64
    out = []
    for column in x.T:
        bits = max(1, int(column.max()).bit_length())
        ones = np.zeros((bits, rows), np.uint8)
        ones[:, : len(x)] = (column >> np.arange(bits, dtype=np.uint64)[:, None]) & np.uint64(1)
        out.append(np.packbits(ones, axis=1).view(np.uint64))
    return out


def products(packed: list[np.ndarray]) -> dict[tuple[int, int], int]:
    """The exact cross-product of every two dimensions, from the ones that each two of their planes share."""
    found = {}
    for i, left in enumerate(packed):
        for j in range(i, len(packed)):
            right, step = packed[j], max(1, HELD // max(1, len(left) * len(packed[j])))
            ones = np.zeros((len(left), len(right)), np.int64)
            for at in range(0, left.shape[1], step):
                both = left[:, None, at : at + step] & right[None, :, at : at + step]
                ones += np.bitwise_count(both).sum(axis=2, dtype=np.int64)
            weighted = ones.astype(object) << (np.arange(len(left))[:, None] + np.arange(len(right))).astype(object)
            found[i, j] = int(weighted.sum())
    return found


def block_sums(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, sum over rows of x_i x_j) for i <= j, and (-1, i, sum of x_i), (-1, -1, number of rows)."""
    least = [int(v) for v in x.min(axis=0)]
    shifted = x.astype(np.uint64) - x.min(axis=0).astype(np.uint64)  # wraps around to the true difference
    packed, n = planes(shifted), len(x)
    sums = [sum(int(np.bitwise_count(plane).sum()) << p for p, plane in enumerate(own)) for own in packed]
    for (i, j), both in products(packed).items():
        yield i, j, both + least[i] * sums[j] + least[j] * sums[i] + n * least[i] * least[j]
    for i, total in enumerate(sums):
        yield -1, i, total + n * least[i]
    yield -1, -1, n


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as (place, part); parts are below 2^LIMB, the last carries the sign. No part for zero."""
    place = 0
    while value:
        part = value & (1 << LIMB) - 1
        if -(1 << LIMB) < value < 0:
            part = value
        yield place, part
        value, place = (value - part) >> LIMB, place + 1


def scatter(fit: DataFrame) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """Rows, sums and cross-products of a fit list of whole vectors in column x, as Python's whole numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = matrix(batch.column("x").slice(at, BLOCK))
                rows = [(i, j, place, part) for i, j, value in block_sums(x) for place, part in limbs(value)]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["i", "j", "place", "part"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, place int, part long")
    total: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "place").agg(F.sum("part").alias("part")).collect():  # as many as pairs of dimensions
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["part"] << LIMB * r["place"])
    n = total.pop((-1, -1), 0)
    d = 1 + max((j for i, j in total if i >= 0), default=-1) if total else 0
    return n, [total.pop((-1, i), 0) for i in range(d)], total


# -- components ---------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """Fit rows, their sums, unit components as columns, their eigenvalues, and the whole variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole vectors, centred, on the components, each over the root of its eigenvalue."""
        return (self.n * x - np.array(self.sums, x.dtype)).astype(np.float64) / self.n @ self.components / np.sqrt(self.values)


def learn(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of most variance; None where nothing varies."""
    n, sums, both = scatter(fit)
    d = len(sums)
    centred = [[n * both.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(centred[i][i] for i in range(d))
    if not trace:
        return None
    # Scaled by a whole number first, so that no entry is too large for a double.
    down = max(0, trace.bit_length() - 900)
    values, vectors = np.linalg.eigh(np.array([[float(v >> down) for v in row] for row in centred]))
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > values[0] * d * np.finfo(float).eps).sum()))
    unit = 2.0**down / n / n
    return Whitening(n, sums, np.ascontiguousarray(vectors[:, :kept]), values[:kept] * unit, float(trace >> down) * unit)


def exact_type(n: int, x: np.ndarray, sums: list[int]):
    """64-bit numbers where n x - S and the sum of its squares stay far inside them, Python's otherwise."""
    largest = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    return np.int64 if largest**2 * x.shape[1] < 1 << 62 else object


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity, measured on its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.components.shape[1]
        total, rows = np.zeros((k, k)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = matrix(batch.column("x").slice(at, BLOCK))
                z = w.whitened(x.astype(exact_type(w.n, x, w.sums)))
                total, rows = total + z.T @ z, rows + len(z)
        if rows:
            i, j = np.indices((k, k)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "both"])

    cells = fit.select("x").mapInArrow(run, "i int, j int, both double").groupBy("i", "j").agg(F.sum("both").alias("both"))
    off = F.abs(F.col("both") / w.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return cells.agg(F.max(off)).first()[0]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for every vector and component."""
    held = usable(vectors).select("vec_id", whole().alias("x"))
    # Copies meet in the map-side sums; the fit list is read twice.
    fit = stored(held.select("x").distinct(), "fit")
    w = learn(fit, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    error, explained = identity_error(fit, w), w.values / w.trace

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column("x"))
                x = x.astype(exact_type(w.n, x, w.sums))
                far = ((w.n * x - np.array(w.sums, x.dtype)) ** 2).sum(axis=1)
                deviation = [int(v) if v < 1 << 63 else None for v in far]
                ids = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(ids)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(ids), w.n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(ids)),
                        pa.array(w.whitened(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(ids), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return held.mapInArrow(run, WHITENED)
