"""Ranked lexical search: item tiles times document tiles, multiplied dense and exact.

Items are dealt to blocks by the number of their terms, so that the vocabulary of a
block is bounded. Per block, each document keeps only its counts of that vocabulary.
Then, tile by tile, the impacts of some documents (rows) on the terms they have
(columns) are multiplied with the weights of the block's items on these terms. Both
are whole numbers in doubles, and terms are taken in tiles small enough for every
partial sum to stay below 2^53, so the products are exact; tiles add up as 64-bit
numbers. Of a tile, an item keeps its k best by score and id, tasks hand on k each,
and a window ranks them.

Terms are judged on UTF-8 bytes: only ASCII letters, digits and bytes above 127 make
them. Each row is a document, repeated rows included; those of one score and id take
neighbouring ranks. Null and empty texts have no terms. A null doc_id ranks after all
others of its score. Rows of one item_id are one item with the terms of all; an item
without id or terms has no results. Empty tables give none. Columns other than
doc_id, item_id and text play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbledger.llm.bpe import slices
from ebbledger.llm.common import stored, text_rows

#: Fixed, as bytes: capitals become small, what is no part of a term becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Fixed: unit of an impact, its damping, and the share of length in it, in hundredths.
UNIT, DAMPING, SHARE = 1_000_000_000, 8, 90
#: Terms of the items of one block, on average; an item with more is a block of its own vocabulary.
BLOCK_TERMS = 50_000
#: Documents of a tile, and bytes of text that are cut into terms at once.
TILE_DOCS, TEXT_BYTES = 512, 1 << 20
#: Doubles of a dense document tile.
TILE_CELLS = 1 << 21
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53
#: Tasks hand on their best rows to this many parts of an item before one window sees them.
PARTS = 64

COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"
FOUND = "item_id long, doc_id long, score long, part int"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists, in order: a long text is cut between terms."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS), 0
    while at < len(data):
        to = data.find(b" ", at + TEXT_BYTES)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct terms of each item, as strings of bytes in hexadecimal."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = {t for some in terms_of(text) for t in some}
                ids += [item] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    return own.mapInArrow(run, "item_id long, term binary").distinct()


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), and number and frequency of the vocabulary's terms, per document."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.get
        for batch in batches:
            for part in slices(batch, "text"):
                n, sizes, terms, tf = [], [0], [], []
                for text in part.column("text").to_pylist():
                    total, own = 0, Counter()
                    for some in terms_of(text):
                        total += len(some)
                        own.update(map(known, some))
                    own.pop(None, None)
                    n.append(total)
                    terms += own.keys()
                    tf += own.values()
                    sizes.append(len(terms))
                at = np.array(sizes, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return text_rows(docs).withColumns({"doc_id": F.col("doc_id").cast("long")}).mapInArrow(run, COUNTED)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def term_tiles(weights: np.ndarray, largest: int, most: int) -> list[tuple[int, int]]:
    """Ranges of columns, of at most `most`, over which no item's weights times the largest impact add up to 2^53."""
    room, tiles, begin = max(1, (EXACT - 1) // largest), [], 0
    sums = np.zeros(weights.shape[0])
    for c in range(weights.shape[1]):
        column = weights[:, c]
        if c > begin and (c - begin >= most or (sums + column).max() > room):
            tiles.append((begin, c))
            begin, sums = c, np.zeros(weights.shape[0])
        sums = sums + column
    return [*tiles, (begin, weights.shape[1])] if weights.shape[1] else []


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a row above zero, by score, then by id. Ties at the border are all looked at."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        border = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= border]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def ranked_block(counts: DataFrame, items: list[tuple[int, list[int]]], weights: dict[int, int], documents: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score, part: the k best of each task for each item of a block.

    `items` holds each item's terms as numbers, `weights` the weight of those that some document holds.
    """
    columns = sorted(weights)
    place = {term: c for c, term in enumerate(columns)}
    names = np.array([item for item, _ in items], np.int64)
    no_id = np.iinfo(np.int64).max
    # Sparse here, dense only on the columns that a tile of documents has.
    cells = [(i, place[t], weights[t]) for i, (_, own) in enumerate(items) for t in own if t in place]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(cells, np.int64).reshape(-1, 3)
        q = q[np.argsort(q[:, 1], kind="stable")]
        column_of = np.full(max(columns) + 1, -1, np.int64)
        column_of[columns] = np.arange(len(columns))
        tops: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                ids = part.column("doc_id").fill_null(no_id).to_numpy()
                sizes = np.array(part.column("terms").value_lengths(), np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                column = column_of[part.column("terms").flatten().to_numpy()]
                tf = part.column("tf").flatten().to_numpy()
                damped = np.array([DAMPING * (100 - SHARE + SHARE * n * documents // total) for n in part.column("n").to_pylist()], np.int64)
                impact = (UNIT * tf) // (1000 * tf + damped[row])
                used, own = np.unique(column, return_inverse=True)
                scores = np.zeros((len(items), part.num_rows), np.int64)
                # The items' weights on the columns of this tile alone.
                first, last = np.searchsorted(q[:, 1], used), np.searchsorted(q[:, 1], used, side="right")
                many = last - first
                picked = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(used) else np.zeros(0, np.int64)
                left = np.zeros((len(items), len(used)))
                left[q[picked, 0], np.repeat(np.arange(len(used)), many)] = q[picked, 2]
                order = np.argsort(own, kind="stable")
                row, own, impact = row[order], own[order], impact[order]
                for a, b in term_tiles(left, int(impact.max(initial=1)), max(1, TILE_CELLS // TILE_DOCS)):
                    lo, hi = np.searchsorted(own, (a, b))
                    right = np.zeros((part.num_rows, b - a))
                    right[row[lo:hi], own[lo:hi] - a] = impact[lo:hi]
                    scores += (left[:, a:b] @ right.T).astype(np.int64)
                for i, line in enumerate(scores):
                    known_scores, known_ids = tops[i]
                    # What is below k known scores cannot rank; equal ones can, by their id.
                    if len(known_scores) == k:
                        line = np.where(line >= known_scores[-1], line, 0)
                    if line.any():
                        both, all_ids = np.concatenate((known_scores, line)), np.concatenate((known_ids, ids))
                        chosen = best(both, all_ids, k)
                        tops[i] = both[chosen], all_ids[chosen]
        task = TaskContext.get().partitionId() % PARTS
        n = [len(s) for s, _ in tops]
        if sum(n):
            scores, ids = (np.concatenate([t[x] for t in tops]) for x in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, n)), pa.array(ids, mask=ids == no_id), pa.array(scores), pa.array(np.full(sum(n), task, np.int32))],
                ["item_id", "doc_id", "score", "part"],
            )

    return counts.mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, whole and exact.

    The documents are read once per block of items. Terms and weights of one block
    pass through the driver: their number is bounded by BLOCK_TERMS, not by the
    tables, but for a single item that has more.
    """
    spark = docs.sparkSession
    terms = stored(item_terms(items), "item-terms")
    blocks = max(1, math.ceil(terms.count() / BLOCK_TERMS))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        held = terms.filter(block_of == block).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        if not held:
            continue
        vocabulary = sorted({bytes(t) for r in held for t in r["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        counts = stored(counted(docs, vocabulary), "counts")
        size = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # at most the vocabulary
        weights = {r["term"]: weight(size["documents"], r["df"]) for r in holding}
        if weights:
            own = [(r["item_id"], [number[bytes(t)] for t in r["terms"]]) for r in held]
            found = found.unionByName(ranked_block(counts, own, weights, size["documents"], size["total"], k))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (("item_id", "part"), ("item_id",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def oracle_sql(k: int = 10) -> str:
    """The same in SQL, for the tables documents and benchmark."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({small}, '{term}') AS terms FROM documents),
lengths AS (SELECT r, doc_id, CAST(len(terms) AS HUGEINT) AS n FROM rows WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS HUGEINT) AS docs, CAST(sum(n) AS HUGEINT) AS total FROM lengths),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({small}, '{term}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
counts AS (
  SELECT r, term, CAST(count(*) AS HUGEINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM rows)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2.0 * count(*) + 1))) AS HUGEINT) AS w
  FROM counts, whole GROUP BY term),
scores AS (
  SELECT item_id, r, doc_id,
    sum(w * (({UNIT} * tf) // (1000 * tf + {DAMPING} * ({100 - SHARE} + ({SHARE} * n * docs) // total)))) AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (r), whole GROUP BY item_id, r, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {k}
"""
