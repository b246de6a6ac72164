"""Language identification by compression.

Each language has a raw-content dictionary: a bounded sample of its own texts. A
text, in lower case, is cut into blocks, every block is compressed once with each
dictionary, and the language with the smallest total wins. Blocks keep the
dictionary in play throughout a long text. The score is the share saved over the
runner-up; where it is under a margin, the row is marked rejected but keeps its
best guess. Where sizes are equal, all ends of the last block are compressed too.

A null text, or one without a letter, is `und` with score 0. Ties go to the
language with more learned documents, then to the first in alphabetical order. With a single language, texts get it with
score 1; with none learned, every text is `und`. A text with a letter always
gets a learned language. Rows stay one to one.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbledger.llm.bpe import slices
from ebbledger.llm.common import text_rows

#: Texts are cut into samples of this many characters; bounds of a language's dictionary: samples, and their bytes.
SAMPLE_CHARS, SAMPLES, DICTIONARY_BYTES = 2_240, 400, 400_000
#: Bytes compressed at a time, and the compressor's level.
BLOCK, LEVEL = 4_096, 6
#: Under this share saved over the second best language, a row is marked rejected.
MARGIN = 0.02


def dictionaries(labelled: DataFrame, samples: int = SAMPLES, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """For each lang, different samples of its texts in the order of their hashes: at most `samples` of them and `size` bytes.

    Whole texts are cut into samples, so every part of them can be learned from.
    Languages with more documents come first. The hash order does not depend on
    partitions. From the number of different samples follows up to which hash some
    twice as many lie as are wanted: only those are handed on, so a hot language, or
    a text that a third of all rows repeat, sends few rows.
    """
    known = text_rows(labelled, "lang").filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    cut = known.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?s).{{1,{SAMPLE_CHARS}}}"), F.lit(0))).alias("text"))
    cut = cut.select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}  # one for each language
    different = cut.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()  # one for each language
    if not different:
        return {}
    upto = F.create_map(*[F.lit(x) for r in different for x in (r["lang"], last_hash(r["n"], 2 * samples + 200))])
    few = cut.filter(F.col("hash") <= F.try_element_at(upto, F.col("lang"))).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("rank") <= samples)
    by: dict[str, list[tuple[int, bytes]]] = {}
    for row in ranked.collect():
        by.setdefault(row["lang"], []).append((row["rank"], row["text"].encode()))
    return {lang: joined(sorted(by[lang]), size) for lang in sorted(by, key=lambda x: (-counts[x], x))}


def last_hash(n: int, wanted: int) -> int:
    """The 64-bit hash up to which about `wanted` of n different ones lie."""
    return 2**63 - 1 if n <= wanted else 2**64 * wanted // n - 2**63


def joined(ranked: list[tuple[int, bytes]], size: int) -> bytes:
    """Whole samples in their order, while they fit."""
    out, room = [], size
    for _, text in ranked:
        if len(text) + 1 <= room:
            out.append(text)
            room -= len(text) + 1
    return b"\n".join(out)


class Sizes:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.by = []
        for lang in self.langs:
            known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def best(self, text: str) -> tuple[str, float]:
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        found = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, c in enumerate(self.by))
        if len(found) == 1:
            return self.langs[0], 1.0
        if found[0][0] == found[1][0]:
            tied, end = [k for size, k in found if size == found[0][0]], blocks[-1]
            best = min((sum(len(self.by[k].compress(end[i:])) for i in range(len(end))), k) for k in tied)[1]
            return self.langs[best], 0.0
        return self.langs[found[0][1]], 1.0 - found[0][0] / found[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs."""

    def run(batches):
        sizes = Sizes(dictionaries)
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [sizes.best(t) if letter and sizes.langs else ("und", 0.0) for t, letter in zip(piece.column("text").to_pylist(), piece.column("letter").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    seen = text_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return seen.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumn("rejected", F.col("score") < margin)
