"""Best-fit packing of token sequences after Martello and Toth's dominance reduction.

Every document is its token ids and an end token; a longer one than a sequence
is cut from its end into whole sequences, so that only its first piece may be
shorter. Pieces differ by their length alone, so the instance is a table of at
most `capacity` counts, however many documents there are. On it the driver

* fixes sets of at most three lengths that dominate every other set with the
  longest of them, as many copies at once as the argument holds for, until no
  such set is left (`reduced`);
* packs what remains by best fit, longest first (`best_fit`).

Pieces get a rank among those of their length from the task that wrote them and
the counts of the tasks before it, and look their place up by that rank. Nothing
is sorted, and a length that a third of all pieces have is as good as any other.

Null and empty texts are the end token alone. Repeated rows are pieces of their
own; a null doc_id stays null. An empty table has no pieces. Columns other than
doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbledger.llm.bpe import OLD, slices, vocabulary
from ebbledger.llm.common import stored, text_rows

#: Fixed: tokens of a sequence, and the id that ends a document.
CAPACITY = 1024
END = 2
#: A run without a space longer than this is left to the vocabulary's own library.
LONG_RUN = 4096
#: More than there can be pieces of one length; length and rank share one 64-bit number.
RANKS = 1 << 48

PIECES = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "bucket": "int", "rank": "long", "ids": "array<int>"}
PLACED = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "array<int>", "sequence_id": "long", "offset": "long"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


# -- token ids ----------------------------------------------------------------


class Ids:
    """The ids of whole texts. Both libraries hold the same vocabulary and give the same ids.

    The faster one splits texts by a newer Unicode, so texts with characters whose
    class may have changed go to the library the file is written for, as do runs
    that the faster one would take quadratic time for.
    """

    def __init__(self, file: str):
        _, ids, special, _ = vocabulary(file)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens=special)
        self.exact = Tokenizer.from_file(file)
        self.exact.no_truncation()
        self.exact.no_padding()

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if OLD.match(text) and max(map(len, text.split(" "))) <= LONG_RUN:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Where a document of this length is cut: whole sequences from its end, the rest first."""
    first = length % capacity
    ends = [*([first] if first else []), *range(first + capacity, length + 1, capacity)]
    return list(zip([0, *ends], ends))


def pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document, length, checksum and, if asked for, its ids.

    `bucket` and `rank` number the pieces of a length within the task that made
    them; they hold only for the rows of one run, so store the result before use.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, seen = Ids(file), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(ids_of.of(text), np.uint32(end)).astype("<u4")
                    for piece, (a, b) in enumerate(cuts(len(ids), capacity)):
                        own = ids[a:b].tobytes()
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(own), task, seen[b - a], own if with_ids else b""))
                        seen[b - a] += 1
                if rows:
                    *columns, held = zip(*rows)
                    at = np.cumsum([0, *(len(x) // 4 for x in held)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(held), np.int32)))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays([*arrays, lists], list(PIECES))

    made = text_rows(docs).withColumns({"doc_id": F.col("doc_id").cast("long")}).mapInArrow(run, ddl(PIECES))
    return made if with_ids else made.drop("ids")


# -- the plan, on counts of lengths -------------------------------------------


@dataclass(frozen=True)
class Fill:
    """A number of sequences with the same contents: (length, how many) in their order."""

    sequences: int
    contents: tuple[tuple[int, int], ...]


def _widest_pair(counts: Counter, sizes: list[int], most: int) -> tuple[int, int] | None:
    """The two lengths of the largest sum up to `most`; of equal sums that with the longest length."""
    best, i, j = None, len(sizes) - 1, 0
    while i >= 0 and j <= i:
        a, b = sizes[i], sizes[j]
        if a + b > most or (i == j and counts[a] < 2):
            if a + b > most:
                i -= 1
            else:
                break
            continue
        # The longest partner of a that fits: j only grows while a shrinks.
        while j + 1 <= i and a + sizes[j + 1] <= most and (j + 1 < i or counts[a] > 1):
            j += 1
        if best is None or a + sizes[j] > sum(best):
            best = (a, sizes[j])
        i -= 1
    return best


def dominating(counts: Counter, longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set of lengths with `longest` that dominates every feasible one, or None if none is proved to.

    A set dominates another if the other can be cut into parts that each fit under
    a length of its own. With k the number of further pieces that can join at most:
    k = 0, the piece stands alone; one partner fills the sequence, or k = 1, the
    longest partner; k = 2, the longest partner where no pair is longer, or the
    longest pair that has that partner, where no pair of two pieces longer than its
    shorter one fits.
    """
    rest = counts.copy()
    rest[longest] -= 1
    sizes = sorted(size for size, n in rest.items() if n)
    room = capacity - longest
    shortest = [size for size in sizes[:3] for _ in range(min(3, rest[size]))][:3]
    most = next((k for k in (3, 2, 1) if len(shortest) >= k and sum(shortest[:k]) <= room), 0)
    if not most:
        return (longest,)
    partner = sizes[bisect_right(sizes, room) - 1]
    if partner == room or most == 1:
        return (longest, partner)
    if most == 3:
        return None
    a, b = _widest_pair(rest, sizes, room)
    if partner >= a + b:
        return (longest, partner)
    between = [size for size in sizes[bisect_right(sizes, b) :] if size < a for _ in range(min(2, rest[size]))][:2]
    if partner == a and (len(between) < 2 or sum(between) > room):
        return (longest, a, b)
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Fill], Counter]:
    """Sequences that some best packing has, and the counts of what remains, which no set dominates any more.

    Removing pieces takes sets away and adds none, so a set that dominates stays
    so while all its lengths last: as many copies are fixed at once.
    """
    left, fixed, changed = Counter({k: n for k, n in counts.items() if n}), [], True
    while changed:
        changed = False
        for longest in sorted(left, reverse=True):
            while left[longest] and (chosen := dominating(left, longest, capacity)):
                need = Counter(chosen)
                copies = min(left[size] // n for size, n in need.items())
                fixed.append(Fill(copies, tuple(need.items())))
                left -= Counter({size: n * copies for size, n in need.items()})
                changed = True
    return fixed, +left


def best_fit(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Best fit, longest first: each piece goes where the least room is left that takes it.

    Sequences with the same contents are kept as one group. A piece that was put in
    leaves its sequence the tightest, so the next of its length follows while it fits.
    """
    open_: dict[int, list[Fill]] = {}
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                room, group = capacity, Fill(-(-n // (capacity // size)), ())
            else:
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // size
            whole = min(group.sequences, n // each)
            n -= whole * each
            split = [(whole, each)]
            if whole < group.sequences:
                split += [(1, n), (group.sequences - whole - 1, 0)] if n else [(group.sequences - whole, 0)]
                n = 0
            for sequences, k in split:
                if sequences:
                    made = Fill(sequences, (*group.contents, (size, k)) if k else group.contents)
                    open_.setdefault(room - k * size, []).append(made)
    return [group for groups in open_.values() for group in groups]


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> list[Fill]:
    """All sequences for pieces of these lengths."""
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(plan: list[Fill]) -> np.ndarray:
    """Rows of (length and first rank as one number, pieces a sequence, first sequence, offset), in order.

    As many as the plan has lengths, which `capacity` bounds.
    """
    rows, taken, sequence = [], Counter(), 0
    for fill in plan:
        offset = 0
        for size, each in fill.contents:
            rows.append((size * RANKS + taken[size], each, sequence, offset))
            taken[size] += each * fill.sequences
            offset += each * size
        sequence += fill.sequences
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# -- placing ------------------------------------------------------------------


def packed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored pieces with their sequence and their offset in it."""
    per_task = made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity`
    table = places(planned(counts, capacity))
    carried = [c for c in PLACED if c in made.columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(table[:, 0], length * RANKS + rank, side="right") - 1]
            place = rank - row[:, 0] % RANKS
            found = pa.array(row[:, 2] + place // row[:, 1]), pa.array(row[:, 3] + place % row[:, 1] * length)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), *found], [*carried, "sequence_id", "offset"])

    ranked = made.join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))
    return ranked.select(*carried, "rank").mapInArrow(run, ddl({c: kind for c, kind in PLACED.items() if c in (*carried, "sequence_id", "offset")}))


def pack(docs: DataFrame, file: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids of every piece of every document."""
    return packed(stored(pieces(docs, file, capacity, end, with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, their pieces in order. A group holds one sequence."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = placed.groupBy("sequence_id").agg(own.alias("own"))
    return joined.select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"))
