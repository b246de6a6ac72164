"""Packing, whitening and lexical search, against plain Python and whole-number arithmetic."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.conftest import frame

from ebbledger.llm import lexical, packing, whitening
from ebbledger.llm.queries import BPE_FILE, ORACLE, QUERIES


# -- packing ------------------------------------------------------------------


@lru_cache(None)
def fewest(sizes: tuple, capacity: int) -> int:
    """The fewest sequences for pieces of these sizes, longest first, by trying every set with the longest."""
    if not sizes:
        return 0
    first, rest, best, seen = sizes[0], sizes[1:], len(sizes), set()

    def sets(at, room, chosen):
        yield chosen
        for i in range(at, len(rest)):
            if rest[i] <= room:
                yield from sets(i + 1, room - rest[i], (*chosen, i))

    for chosen in sets(0, capacity - first, ()):
        left = tuple(s for i, s in enumerate(rest) if i not in chosen)
        if left not in seen:
            seen.add(left)
            best = min(best, 1 + fewest(left, capacity))
    return best


def instances(n):
    r = random.Random(31)
    for _ in range(n):
        capacity = r.choice([10, 20, 30, 50])
        least = r.choice([1, 2, capacity // 5, capacity // 4])
        yield [r.randrange(least, capacity + 1) for _ in range(r.randrange(1, 10))], capacity


def test_reduction_keeps_the_optimum():
    """What is fixed is in some best packing: fixed and the best of the rest are the best of all."""
    fixed_sets = 0
    for sizes, capacity in instances(800):
        fixed, rest = packing.reduced(Counter(sizes), capacity)
        fixed_sets += sum(f.sequences for f in fixed)
        left = tuple(sorted(rest.elements(), reverse=True))
        assert sum(f.sequences for f in fixed) + fewest(left, capacity) == fewest(tuple(sorted(sizes, reverse=True)), capacity), (sizes, capacity)
    assert fixed_sets > 1500


def test_many_copies_are_fixed_as_single_ones_are():
    for sizes, capacity in instances(60):
        many = Counter({s: n * 3 for s, n in Counter(sizes).items()})
        plan = packing.planned(many, capacity)
        assert sum(f.sequences for f in plan) <= 3 * fewest(tuple(sorted(sizes, reverse=True)), capacity)
        held = Counter()
        for f in plan:
            assert sum(size * k for size, k in f.contents) <= capacity
            held += Counter({size: k * f.sequences for size, k in f.contents})
        assert held == many


@pytest.mark.parametrize(
    ("counts", "capacity", "chosen"),
    [
        ({8: 1, 5: 1}, 10, (8,)),  # nothing fits beside it
        ({8: 2, 2: 1, 1: 4}, 10, (8, 2)),  # fills it
        ({6: 1, 4: 1, 3: 1, 1: 9}, 10, (6, 4)),
        ({6: 1, 3: 2}, 10, (6, 3)),  # one more at most: the longest
        ({6: 1, 3: 1, 2: 2}, 11, (6, 3, 2)),  # the widest pair, with the longest partner
        ({10: 1, 5: 1, 4: 1, 3: 1}, 18, (10, 5, 3)),  # the widest pair has the longest partner, and no pair over its shorter one fits
        ({20: 1, 1: 9}, 30, None),
    ],
)
def test_dominating_sets(counts, capacity, chosen):
    assert packing.dominating(Counter(counts), max(counts), capacity) == chosen


def test_best_fit_goes_where_least_room_is_left():
    plan = packing.best_fit({7: 1, 6: 1, 3: 1, 4: 1}, 10)
    assert sorted(tuple(sorted(f.contents)) for f in plan) == [((3, 1), (7, 1)), ((4, 1), (6, 1))]
    assert packing.best_fit({}, 10) == [] and packing.places([]).shape == (0, 4)


def test_cuts():
    assert packing.cuts(3, 4) == [(0, 3)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 5), (5, 9)] and packing.cuts(8, 4) == [(0, 4), (4, 8)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


def check_packed(rows, texts, library, capacity):
    """Pieces cover each text's ids and its end; sequences are gapless and not too long."""
    want = Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_documents_are_packed(awkward, nothing, library, capacity):
    rows, docs = awkward
    made = packing.pack(docs, BPE_FILE, capacity).collect()
    n = check_packed(made, [(i, t) for i, t, *_ in rows], library, capacity)
    assert n <= 1.02 * math.ceil(sum(r.length for r in made) / capacity) + 1
    assert packing.pack(nothing, BPE_FILE, capacity).count() == 0


def test_one_length_may_be_everywhere(spark, library):
    """Two thirds of all rows are one repeated row, in many partitions: ranks stay apart, sequences full."""
    rows = [(i if i % 3 == 0 else 7, "same text here" if i % 3 else f"text {i} " * (i % 40), None, None) for i in range(900)]
    made = packing.pack(frame(spark, rows).repartition(9), BPE_FILE, 64).collect()
    n = check_packed(made, [(i, t) for i, t, *_ in rows], library, 64)
    assert n <= math.ceil(sum(r.length for r in made) / 64) + 1  # the total's bound; best fit may miss it


def test_sequences_have_the_ids(spark, library):
    texts = ["one two three", None, "a" * 200 + " b", "", "漢字 <|endoftext|> x"]
    placed = packing.pack(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), BPE_FILE, 32, with_ids=True)
    ids = Counter(i for r in packing.sequences(placed).collect() for i in r.ids)
    assert ids == Counter(i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 2])


def test_both_libraries_give_the_same_ids(library):
    ids = packing.Ids(BPE_FILE)
    hard = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>", " " * 500, "ab" * 900, "it's I'LL we've", "\n\n \t x  y", "ꟑ𐥀 漢字 ​x", "a \x1c b", "é" * 300, "1234 56,789", "x" * 9000, "naïve Ünder x"]
    assert [ids.of(t).tolist() for t in hard] == [library.encode(t, add_special_tokens=False).ids for t in hard]
    assert ids.of(None).tolist() == [] == ids.of("").tolist()


# -- whitening ----------------------------------------------------------------


def vectors_frame(spark, rows):
    """Embeddings with columns whose names the operator uses itself."""
    floats = lambda v: v and [c if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, floats(v), 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, whitened double, x string")


def plain_whitening(rows):
    """n, whole vectors, sums, covariance in exact fractions of whole numbers."""
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(v[d] for v in fit) for d in range(len(fit[0]))]
    scatter = np.array([[sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for v in fit) / n**3 for b in range(len(s))] for a in range(len(s))])
    return x, n, s, scatter


def test_planes_count_exactly():
    r = random.Random(4)
    for most in (2, 100, 1 << 40, (1 << 63) - 1):
        x = np.array([[r.randrange(-most, most) for _ in range(5)] for _ in range(130)], np.int64)
        x[:, 4] = x[0, 4]  # a dimension without variance
        exact = x.astype(object)
        for i, j, value in whitening.block_sums(x):
            assert value == ((exact[:, i] * exact[:, j]).sum() if i >= 0 else exact[:, j].sum() if j >= 0 else 130)
    values = [0, 1, -1, -(1 << 32), (1 << 32) - 1, -(1 << 100) + 5, *(r.randrange(-1 << 90, 1 << 90) for _ in range(50))]
    for value in values:
        assert sum(part << whitening.LIMB * place for place, part in whitening.limbs(value)) == value


def test_whitening_of_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 64)
    r = np.random.default_rng(3)
    mixed = r.normal(size=(6, 6))
    rows = [(i, (r.normal(size=6) @ mixed).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 500)] + [rows[5], (None, rows[7][1])]  # copies, a repeated row, no id
    bad = [(900, None), (901, []), (902, [1.0, None, 1, 1, 1, 1]), (903, [float("nan")] * 6), (904, [float("inf"), 0, 0, 0, 0, 0]), (905, [1.0, 2.0])]
    got = whitening.whiten(vectors_frame(spark, rows + bad).repartition(5), components=4).collect()
    x, n, s, scatter = plain_whitening(rows)
    assert len(got) == 4 * len(rows) and {g.n for g in got} == {n} and {g.vec_id for g in got} == set(x)
    values, axes = np.linalg.eigh(scatter)
    values, axes = values[::-1], axes[:, ::-1]
    by = {(g.vec_id, g.component): g for g in got}
    for i, v in x.items():
        for k in range(4):
            g = by[i, k + 1]
            sign = np.sign(by[0, k + 1].whitened) * np.sign((np.array(x[0]) - np.array(s) / n) @ axes[:, k])
            assert g.deviation == sum((n * a - b) ** 2 for a, b in zip(v, s))
            assert g.whitened == pytest.approx(sign * ((np.array(v) - np.array(s) / n) @ axes[:, k]) / math.sqrt(values[k]), rel=1e-6, abs=1e-7)
            assert g.explained == pytest.approx(values[k] / np.trace(scatter), rel=1e-9) and g.identity_error < 1e-9


def test_whitening_of_little_or_nothing(spark):
    schema = vectors_frame(spark, []).schema
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0  # one distinct vector
    line = whitening.whiten(vectors_frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()  # one component has variance
    assert sorted((g.vec_id, g.component, g.n, g.deviation, abs(g.whitened), g.explained) for g in line) == [(i, 1, 2, 64 * 64, 1.0, 1.0) for i in (1, 2)]
    huge = whitening.whiten(vectors_frame(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 5.0])])).collect()
    assert len(huge) == 3 and all(math.isfinite(g.whitened) for g in huge)  # beside the first, the second is lost in rounding
    assert {g.vec_id for g in huge if g.deviation is None} == {1, 3}  # beyond 64 bits
    tied = whitening.whiten(vectors_frame(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 2.0])])).collect()
    assert {g.vec_id for g in tied} == {3, 4}  # two lengths as common: the longer


# -- lexical search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    holding = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item].update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for (doc_id, bag), n in zip(bags, lengths):
            m = 10 + 90 * n * n_docs // total if total else 10
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in own if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "item_id long, text string, score int, rank int, terms string")


@pytest.mark.parametrize("small", [False, True])
def test_search_is_the_plain_one(spark, awkward, monkeypatch, small):
    """Whole texts with ties, repeats and nulls; the second time in many blocks and tiles."""
    rows, docs = awkward
    if small:
        for name, value in {"BLOCK_TERMS": 12, "TILE_DOCS": 7, "TILE_CELLS": 28, "TEXT_BYTES": 10}.items():
            monkeypatch.setattr(lexical, name, value)
    asked = [(i, rows[i][1]) for i in range(0, 20, 2)] + [(50, "alpha ALPHA délta ü 3"), (51, None), (52, ""), (53, "nowhere to be found"), (54, "w1 w2"), (54, "of the"), (54, "w1 w2"), (None, "alpha")]
    got = lexical.search(docs, items_frame(spark, asked), k=6).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_search([(i, t) for i, t, *_ in rows], asked, 6)


def test_search_of_nothing(spark, awkward, nothing):
    some = items_frame(spark, [(1, "alpha"), (2, "of")])
    assert lexical.search(nothing, some).count() == 0 == lexical.search(awkward[1], items_frame(spark, [])).count()
    blank = frame(spark, [(1, None, None, None), (2, " .. ", None, None)])
    assert lexical.search(blank, some).count() == 0
    assert lexical.search(awkward[1], items_frame(spark, [(1, None), (2, "--")])).count() == 0


def test_products_stay_exact():
    """Tiles end before any item's weights times the largest impact can reach 2^53."""
    weights = np.array([[9e9] * 7, [1.0] * 7])
    for a, b in lexical.term_tiles(weights, 300_000, 100):
        assert weights[:, a:b].sum(1).max() * 300_000 < 2**53
    assert lexical.term_tiles(weights, 1, 3) == [(0, 3), (3, 6), (6, 7)] and lexical.term_tiles(np.zeros((2, 0)), 1, 3) == []


def test_best_keeps_ties_by_id():
    scores, ids = np.array([5, 7, 5, 0, 5, 9]), np.array([8, 1, 3, 2, 4, 6])
    assert ids[lexical.best(scores, ids, 3)].tolist() == [6, 1, 3] and ids[lexical.best(scores, ids, 9)].tolist() == [6, 1, 3, 4, 8]


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    text = "Ab1-cd ÉÉ" * 50 + "x" * 300 + " end"
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(lexical, "TEXT_BYTES", size)
        assert [t.decode() for some in lexical.terms_of(text) for t in some] == terms(text)


# -- the registered queries ---------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    """A scale folder with the awkward documents, items of their texts, and vectors, each with clashing columns."""
    rows, docs = awkward
    root = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{root}/documents.parquet")
    items_frame(spark, [(i, rows[i][1]) for i in range(30)] + [(40, "alpha of the 3")]).write.parquet(f"{root}/benchmark.parquet")
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=20).astype(np.float32).tolist()) for i in range(200)]
    vectors_frame(spark, vectors + vectors[:9] + [(900, None)]).write.parquet(f"{root}/embeddings.parquet")
    return root


def test_op11(spark, awkward, folder, library):
    df = QUERIES["op11_packing"](spark, folder)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    check_packed(df.collect(), [(i, t) for i, t, *_ in awkward[0]], library, 1024)


def test_op12(spark, folder):
    df = QUERIES["op12_whitening"](spark, folder)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = df.collect()
    assert len(rows) == 209 * 16 and {r.n for r in rows} == {200} and rows[0].identity_error <= 1e-4
    held = {r.vec_id: [float(c) for c in r.embedding] for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding is not null").collect()}
    x, n, s, scatter = plain_whitening(list(held.items()))
    values, axes = np.linalg.eigh(scatter)
    for r in rows:
        k = 20 - r.component
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s)) and r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs((np.array(x[r.vec_id]) - np.array(s) / n) @ axes[:, k]) / math.sqrt(values[k]), rel=1e-6, abs=1e-7)


def test_op13(spark, awkward, folder):
    df = QUERIES["op13_lexical_search"](spark, folder)
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    got = sorted((tuple(r) for r in df.collect()), key=str)
    asked = [(i, awkward[0][i][1]) for i in range(30)] + [(40, "alpha of the 3")]
    assert got == plain_search([(i, t) for i, t, *_ in awkward[0]], asked, 10)
    with duckdb.connect() as duck:
        for name in ("documents", "benchmark"):
            duck.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
        assert got == sorted(duck.sql(ORACLE["op13_lexical_search"]).fetchall(), key=str)
    assert df.groupBy("item_id").agg(F.countDistinct("rank").alias("a"), F.count("rank").alias("b")).where("a <> b").count() == 0
