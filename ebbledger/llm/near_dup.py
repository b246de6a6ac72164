"""Near duplicates: MinHash bands for candidates, sequential Bayesian checks, full sets to confirm.

1. Every text becomes the set of its word shingles, a MinHash signature of it and
   a 128-bit digest; texts with equal sets are one class from here on.
2. Signatures are cut into bands. In each bucket of equal bands every class is
   paired with the bucket's hub, one pair a member however large the bucket.
3. A pair's signatures are compared in batches. With m of n values equal and a
   uniform prior, the chance that the similarity reaches the threshold is that of
   at most m hits in n + 1 draws; once it is under `MISS`, the pair is dropped.
4. Each class is confirmed against the best of its surviving hubs, on full sets.
5. Buckets that still hold more than one component are compared member by member
   in blocks inside the tasks, across components only. First each member's most
   similar one is confirmed, one pair a member. Then, for the components that are
   left, every pair that step 3 does not drop is compared, in the first band that it
   shares, on sets of hashes cut to 32 bits, and confirmed if those reach the
   threshold. So a bucket of any size loses no link that its bands propose, and
   sends out few pairs.

The number of bands follows from the threshold and `MISS`.

Rows without words, null and empty texts included, are linked with nothing: their
component is their own doc_id. Rows with a null doc_id take part, and have the
component of their class; kept is true for them only if it has no id at all.
Repeated rows are of one class, and are all marked kept if their id is the
component's smallest. `deduplicated` leaves one row for an id, and all rows
without an id. Where one id has several texts, each text is a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger.llm import bytewise
from ebbledger.llm.bpe import slices
from ebbledger.llm.common import stored, text_rows
from ebbledger.llm.components import components, jumped

#: Values in a band; chance that a pair at the threshold shares no band, and that a step of the checks drops it.
ROWS, MISS = 4, 1e-6
#: Signature values compared at a time, and members of a bucket compared with each other at a time.
STEP, BLOCK = 16, 256


def n_bands(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))) if threshold < 1 else 1


def least_equal(n: int, threshold: float) -> int:
    """The fewest equal values of n at which the threshold is still likelier than MISS."""
    below, m = 0.0, -1
    while below < MISS and m < n:
        m += 1
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin (and the last end)."""
    data, begins = bytewise.joined([(t or "").encode() for t in texts])
    data = bytewise.LOWER[data]
    begin, end = bytewise.words(data)
    doc = np.searchsorted(begins, begin, "right") - 1
    h, owner = bytewise.shingles(bytewise.Hashes(data).of(begin, end), doc, size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def digest(shingles: bytes) -> bytes | None:
    return blake2b(shingles, digest_size=16).digest() if shingles else None


def factors(n: int) -> np.ndarray:
    return np.random.default_rng(977).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), signature, bands of every row."""
    bands = n_bands(threshold)
    k = bands * ROWS

    def run(batches) -> Iterator[pa.RecordBatch]:
        by = factors(k)
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                h, at = shingle_sets(piece.column("text").to_pylist(), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                least = np.zeros((len(n), k), np.uint32)
                if len(full):
                    for j in range(k):
                        least[full, j] = np.minimum.reduceat((h * by[j]) >> np.uint64(32), at[full])
                cut = np.zeros((len(n), bands), np.uint64)
                for r in range(ROWS):
                    cut = bytewise.mixed(cut * bytewise.BASE + least[:, r::ROWS])
                cut = bytewise.mixed(cut + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                keys = [digest(h[a:b].tobytes()) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in least], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, cut.size + 1, bands), pa.int32()), pa.array(cut.ravel()))],
                    ["doc_id", "n_shingles", "key", "signature", "bands"],
                )

    return text_rows(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_shingles long, key binary, signature binary, bands array<long>")


def compared(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signature rows, those never dropped, and how many values they have equal."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for begin in range(0, a.shape[1], STEP):
        stop = min(a.shape[1], begin + STEP)
        equal = equal + (a[alive, begin:stop] == b[alive, begin:stop]).sum(1)
        on = equal >= least_equal(stop, threshold)
        alive, equal = alive[on], equal[on]
    return alive, equal


def array_of(column: pa.Array, kind) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def checked(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b, equal of the pairs (a, sa, b, sb) that the sequential checks leave."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive, equal = compared(array_of(batch.column("sa"), np.uint32), array_of(batch.column("sb"), np.uint32), threshold)
                index = pa.array(alive)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(index), batch.column("b").take(index), pa.array(equal)], ["a", "b", "equal"])

    return pairs.select("a", "sa", "b", "sb").mapInArrow(run, "a binary, b binary, equal long")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """key, shingles of the texts of the documents named in ids (doc_id): sets are made anew, once each."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                h, at = shingle_sets(piece.column("text").to_pylist(), size)
                sets = [h[x:y].tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    wanted = ids.select(F.col("doc_id").alias("wanted")).distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    return texts.mapInArrow(run, "key binary, shingles binary").filter("key is not null").dropDuplicates(["key"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose full shingle sets reach the percentage."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            index = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(index), batch.column("b").take(index)], ["a", "b"])

    sides = pairs.select("a", "b").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    return sides.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "sa", "b", "sb").mapInArrow(run, "a binary, b binary")


def shortened(sets: DataFrame) -> DataFrame:
    """key, short: the shingle hashes of each set cut to 32 bits, sorted."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.unique(np.frombuffer(x.as_buffer(), np.uint64).astype(np.uint32)).tobytes() for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(short, pa.binary())], ["key", "short"])

    return sets.mapInArrow(run, "key binary, short binary")


def crossing(members: DataFrame, bands: int, threshold: float, best: bool) -> DataFrame:
    """a, b of members of one bucket but different components that may be linked.

    With best: for each member that is not of the largest component of a block, the
    one with the most equal signature values. Else: of all pairs that the checks
    leave, each in its first common band, those whose shortened sets reach the
    threshold, give or take two hashes that fall together, as far as they join what
    is not surely joined yet in the block. So pairs are few: one a member, and those
    within a few hashes of the threshold.
    members: bucket, band, parts (blocks of the bucket), root, key, signature, and short unless best.
    """
    parts = F.col("parts")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    group, rest = ["bucket", "i", "j"], ["own", "root", "key", "signature", *([] if best else ["short"])]
    blocks = members.withColumn("own", own).withColumn("other", other).select("bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest)
    blocks = blocks.repartition(*group).sortWithinPartitions(*group)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        band, i, j = rows.column("band")[0].as_py(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        own, n = rows.column("own").to_numpy(), rows.num_rows
        signature = array_of(rows.column("signature").combine_chunks(), np.uint32)
        keys, names = rows.column("key").to_pylist(), rows.column("root").to_pylist()
        short = [] if best else [np.frombuffer(x, np.uint32) for x in rows.column("short").to_pylist()]
        number = {r: k for k, r in enumerate(dict.fromkeys(names))}
        roots = np.array([number[r] for r in names])
        few = roots != np.argmax(np.bincount(roots))  # any pair across components has one of these
        out: list[tuple[int, int]] = []
        for one in np.flatnonzero(few):  # a row against a block: memory stays small
            other = (own == (j if own[one] == i else i)) & (roots != roots[one])
            mates = np.flatnonzero(other if best else other & (~few | (np.arange(n) > one)))
            alive, equal = compared(np.broadcast_to(signature[one], (len(mates), signature.shape[1])), signature[mates], threshold)
            mates = mates[alive]
            if best:
                out += [(one, mates[np.argmax(equal)])] if len(mates) else []
                continue
            same = (signature[mates].reshape(-1, bands, ROWS) == signature[one].reshape(bands, ROWS)).all(2)
            mates = mates[np.argmax(same, axis=1) == band]
            if not len(mates):
                continue
            mine, sizes = short[one], np.array([len(short[m]) for m in mates])
            flat = np.concatenate([short[m] for m in mates])
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
            over = lambda more: both + more >= threshold * (len(mine) + sizes - both - more) - 1e-9  # noqa: E731, B023
            for mate, sure in zip(mates[over(2)], over(-1)[over(2)]):
                if roots[mate] != roots[one]:
                    out.append((one, mate))
                    if sure:  # else it may yet fail, and another pair of the two components hold
                        roots[roots == roots[mate]] = roots[one]
        pick = lambda f: pa.array([f(keys[x], keys[y]) for x, y in out], pa.binary())
        return pa.RecordBatch.from_arrays([pick(min), pick(max)], ["a", "b"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            marks = np.stack([held.column(c).to_numpy() for c in group])
            ends = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1)]
            for a, b in zip(ends, ends[1:]):
                yield pairs(held.slice(a, b - a))
            held = held.slice(ends[-1])
        if held is not None and held.num_rows:
            yield pairs(held)

    return blocks.mapInArrow(run, "a binary, b binary")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after more links: only edges between roots are left to connect."""
    edges = links
    for side in ("a", "b"):
        edges = edges.join(roots.select(F.col("key").alias(side), F.col("root").alias(f"root_{side}")), side)
    edges = stored(edges.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return roots
    onto = components(edges).select(F.col("key").alias("root"), F.col("root").alias("onto"))
    return stored(roots.join(onto, "root", "left").select("key", F.coalesce("onto", "root").alias("root")), "roots")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Two texts are linked when the shared part of their sets of `size`-word shingles
    is at least `percent` hundredths of the whole.
    """
    threshold = percent / 100
    bands = n_bands(threshold)
    docs = text_rows(docs)
    rows = stored(signed(docs, size, threshold), "signed")
    some = rows.filter("key is not null")
    classes = stored(
        some.groupBy("key").agg(F.min("doc_id").alias("least"), F.first(F.struct("signature", "bands")).alias("made")).select("key", "least", "made.*"), "classes"
    )
    band = classes.select("key", F.posexplode("bands").alias("band", "bucket"))
    hubs = band.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(band.join(hubs, "bucket"), "shared")
    signatures = classes.select("key", "signature")
    ids = shared.select("key").distinct().join(classes.select("key", F.col("least").alias("doc_id")), "key")
    sets = stored(full_sets(docs, ids, size), "sets")
    pairs = shared.filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    pairs = pairs.join(signatures.select(F.col("key").alias("b"), F.col("signature").alias("sb")), "b").join(signatures.select(F.col("key").alias("a"), F.col("signature").alias("sa")), "a")
    best = checked(pairs, threshold).groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a"))
    links = confirmed(stored(best, "pairs"), sets, percent)  # a hub is the smallest key of its bucket
    roots = ids.select("key").join(jumped(links.select(F.col("b").alias("key"), F.col("a").alias("parent"))), "key", "left")
    roots = stored(roots.select("key", F.coalesce("root", "key").alias("root")), "roots")
    for one_each in (True, False):
        in_bucket = shared.join(roots, "key")
        mixed = in_bucket.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.max("n").alias("n")).filter("first <> last").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
        rest = in_bucket.select("bucket", "band", "root", "key").join(mixed, "bucket").join(signatures, "key")
        if not one_each:
            rest = rest.join(shortened(sets), "key")
        pairs = stored(crossing(rest, bands, threshold, one_each).distinct(), "pairs")
        roots = merged(roots, confirmed(pairs, sets, percent))
    of_class = classes.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component"))
    of_class = of_class.join(least, "root").select("key", "component")
    return rows.join(of_class, "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one for each component: that of its smallest doc_id. Rows without words are all kept, one for an id."""
    kept = near_duplicates(docs, size, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi")
    return named.select(docs.columns).union(docs.filter("doc_id is null"))
