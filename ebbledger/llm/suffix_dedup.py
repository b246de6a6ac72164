"""Removal of long byte strings that occur more than once, by sorting suffixes at a difference cover.

Two suffixes share their first `length` bytes if and only if they stand next to
each other, or in one run, when all suffixes are sorted to that depth. As in the
difference-cover construction of suffix arrays:

1. Sample. Of each text the positions whose remainder modulo v is in a difference
   cover are sampled: for any two positions there is a shift under v that brings
   both onto sampled ones. Their tuples, of length - v + 1 bytes, are sorted and
   named, and a name held by one position only is discarded: no string of `length`
   bytes that repeats lacks a repeated name within its first v positions.
2. Recursion on names would order the sampled suffixes further. Strings matter here
   only to a depth of `length`, and names are already equal or different to the
   depth of a whole tuple, so the recursion ends after its first level.
3. Merge. The remaining suffixes - all positions less than v before a repeated name -
   are sorted by their first `length` bytes, and neighbours compared.

Sorting is by 64-bit fingerprints of the bytes: the order among different prefixes
does not matter, only that equal ones meet. The sort is a shuffle by ranges of the
fingerprint and a sort of each range inside a task. Texts that are equal as a whole
are brought together first and worked on once. Texts travel in slices of bounded
size; a slice sends each fingerprint once, however often it has it, and gets back
one bit for each, so a passage that a third of all texts share is no hot key.

A null text is an empty one. Texts shorter than `length` keep all bytes. Matches
never cross texts. Copies, repeated rows included, are texts of their own: each
byte of a text of `length` bytes or more that occurs twice goes. Kept bytes may
not be UTF-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger.llm import bytewise
from ebbledger.llm.common import stored, text_rows

#: Bytes of text in a slice, and fingerprints in a range, about.
SLICE, RANGE = 1_000_000, 1_000_000


def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """v up to `most` and a cover modulo v, by Colbourn and Ling's rule: 6r + 4 numbers for v = 24r^2 + 36r + 13."""
    r = 0
    while 24 * (r + 1) ** 2 + 36 * (r + 1) + 13 <= most:
        r += 1
    if 13 > most:
        return 1, np.zeros(1, np.int64)
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *gaps])


def sliced(docs: DataFrame) -> DataFrame:
    """slice, digests, copies, begins, data: the distinct texts, packed into slices, stored."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            begins = np.cumsum([0, *(len(t) for _, _, t in held)])
            row = [held[0][0]], [[d for d, _, _ in held]], [[c for _, c, _ in held]], [begins.tolist()], [b"".join(t for _, _, t in held)]
            kinds = pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["slice", "digests", "copies", "begins", "data"])

        for batch in batches:
            for digest, copies, text in zip(batch.column("digest"), batch.column("copies"), batch.column("text")):
                held.append((digest.as_py(), copies.as_py(), text.as_py()))
                size += len(held[-1][2])
                if size >= SLICE:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    texts = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return stored(texts.select("digest", "copies", "text").mapInArrow(run, "slice binary, digests array<binary>, copies array<long>, begins array<long>, data binary"), "slices")


class Slice:
    """One row of `sliced`: its fingerprints, and what has been found about them."""

    def __init__(self, begins: list[int], data: bytes, length: int):
        self.data = np.frombuffer(data, np.uint8)
        self.begins, self.length = np.array(begins, np.int64), length
        self.hashes = bytewise.Hashes(self.data)
        self.v, self.cover = difference_cover(length // 2)
        self.room = np.repeat(self.begins[1:], np.diff(self.begins)) - np.arange(len(self.data))  # bytes to the text's end

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions, and fingerprints of the tuples there."""
        here = np.zeros(self.v, bool)
        here[self.cover] = True
        place = np.arange(len(self.data)) - np.repeat(self.begins[:-1], np.diff(self.begins))
        width = self.length - self.v + 1
        at = np.flatnonzero(here[place % self.v] & (self.room >= width))
        return at, self.hashes.of(at, at + width)

    def rest(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions less than v before a repeated name, and fingerprints of the strings there. mask: of the names' keys."""
        at, names = self.names()
        repeated = at[hits(names, mask)]
        near = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(near, np.maximum(repeated - self.v + 1, 0), 1)
        np.add.at(near, repeated + 1, -1)
        spots = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.room >= self.length))
        return spots, self.hashes.of(spots, spots + self.length)


def keyed(fingerprints: np.ndarray) -> np.ndarray:
    return np.unique(fingerprints)


def hits(fingerprints: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which fingerprints repeat: in the slice, or, by the mask over its keys, elsewhere."""
    _, inverse, counts = np.unique(fingerprints, return_inverse=True, return_counts=True)
    return ((counts > 1) | mask)[inverse] if len(fingerprints) else np.zeros(0, bool)


def unmasked(parts: list | None) -> np.ndarray:
    """The mask over a slice's keys from the bits of its ranges."""
    parts = sorted((p["range"], p["n"], p["bits"]) for p in parts or ())
    return np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for _, n, bits in parts]).astype(bool) if parts else np.zeros(0, bool)


def met(keys: DataFrame) -> DataFrame:
    """slice, parts: for the sorted keys that slices sent by range, one bit each: whether another slice has it too.

    keys: range, slice, keys (64-bit numbers in a row).
    """

    def answer(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        arrays = [np.frombuffer(k, np.uint64) for _, _, k in held]
        sizes = [len(a) for a in arrays]
        every = np.concatenate(arrays)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = np.zeros(len(every) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        found = np.zeros(len(every), bool)
        found[order] = same[1:] | same[:-1]
        cuts = np.cumsum([0, *sizes])
        bits = [np.packbits(found[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        columns = [pa.array([s for _, s, _ in held], pa.binary()), pa.array([r for r, _, _ in held], pa.int32()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["slice", "range", "n", "bits"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "slice", "keys"))):
                if held and held[0][0] != row[0]:
                    yield answer(held)
                    held = []
                held.append(row)
        if held:
            yield answer(held)

    sent = keys.repartition("range").sortWithinPartitions("range")
    found = stored(sent.mapInArrow(run, "slice binary, range int, n int, bits binary"), "met")
    return found.groupBy("slice").agg(F.collect_list(F.struct("range", "n", "bits")).alias("parts"))  # one for each range


def sent(slices: DataFrame, length: int, ranges: int, named: bool) -> DataFrame:
    """range, slice, keys of the slices: of names, or, with named, of the remaining suffixes."""
    shift = 64 - int(math.log2(ranges))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = Slice(row["begins"], row["data"], length)
                keys = keyed((one.rest(unmasked(row["parts"])) if named else one.names())[1])
                cuts = np.searchsorted(keys >> np.uint64(shift) if shift < 64 else keys * 0, np.arange(ranges + 1))
                full = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
                columns = [pa.array(full, pa.int32()), pa.array([row["slice"]] * len(full), pa.binary()), pa.array([keys[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "slice", "keys"])

    columns = ["slice", "begins", "data", *(["parts"] if named else [])]
    return slices.select(columns).mapInArrow(run, "range int, slice binary, keys binary")


def removed(slices: DataFrame, length: int) -> DataFrame:
    """digest, n_bytes, starts, ends (of the removed runs), kept_sha256 of every distinct text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = Slice(row["begins"], row["data"], length)
                spots, strings = one.rest(unmasked(row["parts"]))
                repeated = spots[hits(strings, unmasked(row["more"]))]
                cover = np.zeros(len(one.data) + 1, np.int32)
                np.add.at(cover, repeated, 1)
                np.add.at(cover, repeated + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out: list[tuple] = []
                for digest, copies, a, b in zip(row["digests"], row["copies"], row["begins"], row["begins"][1:]):
                    own = np.ones(b - a, bool) if copies > 1 and b - a >= length else gone[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                    out.append((digest, b - a, edge[::2].tolist(), edge[1::2].tolist(), sha256(one.data[a:b][~own].tobytes()).hexdigest()))
                kinds = pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["digest", "n_bytes", "starts", "ends", "kept_sha256"])

    return slices.select("digests", "copies", "begins", "data", "parts", "more").mapInArrow(run, "digest binary, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string")


def repeated_strings(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, starts, ends (of the removed runs of bytes), kept_sha256 for every row of docs."""
    rows = text_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    slices = sliced(rows)
    total = slices.agg(F.sum(F.length("data"))).first()[0] or 0
    ranges = 2 ** max(0, math.ceil(math.log2(max(1, total // (8 * RANGE)))))
    names = met(sent(slices, length, ranges, named=False))
    slices = slices.join(names, "slice", "left")
    rest = met(sent(slices, length, ranges, named=True)).withColumnRenamed("parts", "more")
    found = removed(slices.join(rest, "slice", "left"), length)
    return rows.select("doc_id", "digest").join(found, "digest").select("doc_id", "n_bytes", "starts", "ends", "kept_sha256")
