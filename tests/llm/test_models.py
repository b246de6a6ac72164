"""Operators that learn, tokenize, search and mix; the pipeline; what they may import."""

import ast
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import plain
from llm.conftest import frame

import corpus_pipeline
from ebbledger.llm import bpe, hamming_ann, langid, mixing, quality_mil, toxicity
from ebbledger.llm.queries import BPE_FILE, ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Merges(BPE_FILE))


def ids_of(encoder, texts):
    return [np.frombuffer(b, np.int32).tolist() for b in encoder.batch(texts)]


@given(st.lists(st.text(max_size=80), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(library, encoder, texts):
    assert ids_of(encoder, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(library, encoder):
    texts = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|>", " " * 500, "a" * 3000, "ab" * 900, "it's I'LL we've", "\n\n \t x  y", "ꟑ𐥀 漢字 ​x", "a \x1c b", "é" * 300, "1234 56,789"]
    assert ids_of(encoder, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_and_decode(awkward, nothing, library):
    rows, docs = awkward
    got = bpe.decode(bpe.encode(docs, BPE_FILE), BPE_FILE).collect()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == want
    assert bpe.digests(bpe.decode(bpe.encode(nothing, BPE_FILE), BPE_FILE)).count() == 0


def test_broken_utf8_decodes_like_the_library(spark, library):
    ids = [[128, 200, 64], [library.encode("漢").ids[0], 64], [50256, 11]]
    got = bpe.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>"), BPE_FILE).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


SAID = {"aa": "ka lo mi ru te na so", "bb": "zur blik drom stef knal", "cc": "ooui aieu eiou uoia iea"}


def test_languages(spark, nothing):
    r = random.Random(4)
    say = lambda lang, n: " ".join(r.choice(SAID[lang].split()) for _ in range(n))
    rows = [(i, say(lang, r.randrange(20, 200)), lang, None) for i, lang in enumerate(list(SAID) * 60)]
    known = langid.dictionaries(frame(spark, rows[:90]))
    assert sorted(known) == sorted(SAID) and all(len(d) <= langid.DICTIONARY_BYTES for d in known.values())
    asked = rows[90:] + [(900, None, None, None), (901, "", None, None), (902, "12 34 ...", None, None), (903, say("bb", 40_000), None, None), (None, say("cc", 50), None, None)]
    got = {x["doc_id"]: x for x in langid.identify(frame(spark, asked), known).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[90:]) >= 88
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "bb" and got[None]["lang_pred"] == "cc" and all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.dictionaries(nothing) == {}
    assert {x["lang_pred"] for x in langid.identify(frame(spark, asked[:3]), {}).collect()} == {"und"}
    assert {x["lang_pred"] for x in langid.identify(frame(spark, asked[:3]), {"xx": b"abc"}).collect()} == {"xx"}


def labelled(rows, name):
    return lambda spark: spark.createDataFrame(rows, f"doc_id long, text string, {name} int")


def test_quality_learns_from_passages(spark, awkward, nothing):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["word", "other", "thing", "Some", "text."]) for _ in range(r.randrange(30, 300)))
    bad = lambda: good() + " " + " ".join(r.choice(["BUY###", "NOW***", "|", "$$$"]) for _ in range(100))
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 > 0)) for i in range(800)]
    model = quality_mil.learn(labelled(rows[:600], "quality")(spark))
    got = {x["doc_id"]: x for x in quality_mil.score(labelled(rows[600:], "quality")(spark), model).collect()}
    assert sum((got[i]["score"] >= 0.5) == bool(q) for i, _, q in rows[600:]) >= 196
    scored = quality_mil.score(awkward[1], model).collect()
    assert len(scored) == len(awkward[0]) and all(0 <= x["score"] <= 1 and x["n_passages"] >= 1 for x in scored)
    assert quality_mil.score(nothing, model).count() == 0
    kept = quality_mil.accepted(awkward[1], model, 0.5)
    assert kept.columns == awkward[1].columns and kept.count() == sum(x["score"] >= 0.5 for x in scored)
    blind = quality_mil.learn(labelled(rows, "quality")(spark).limit(0))
    assert {x["score"] for x in quality_mil.score(awkward[1], blind).collect()} == {0.5}


def test_attention_gradients():
    r = np.random.default_rng(0)
    x, n, y = r.random((9, quality_mil.FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = quality_mil.trained(x, n, y)
    loss = lambda: -np.mean(y * np.log(model.forward(x, n)["score"]) + (1 - y) * np.log(1 - model.forward(x, n)["score"]))
    for name, gradient in model.gradients(x, n, y).items():
        at = tuple(0 for _ in gradient.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - gradient[at]) < 1e-6, name
        model.p[name][at] = old


def test_folding():
    assert toxicity.folded("You 1D10T!!! and $tup1d, bаd (Cyrillic) é​x") == " you idiot and stupid bad cyrillic ex "
    assert toxicity.folded("") == "  " and toxicity.folded("12 ### !!") == "  "


def test_toxicity(spark, awkward, nothing):
    r = random.Random(7)
    say = lambda n, *more: " ".join([*(r.choice("one two three four five six".split()) for _ in range(n)), *more])
    rows = [(i, say(r.randrange(20, 80), *(["nasty", "vile"][i % 2 : i % 2 + 1] if i % 5 == 0 else [])) + " end", int(i % 5 == 0)) for i in range(600)]
    rows += [(1000 + i, say(30, "nasty", "weather", "today"), 0) for i in range(12)]
    lexicon = toxicity.learn(labelled(rows, "toxic")(spark))
    assert {" nasty ", " vile "} <= lexicon.weights.keys() and "nasty weather" in lexicon.exceptions
    asked = [(1, say(30, "NÁSTY")), (2, say(30)), (3, say(30, "v1le")), (4, say(30, "nasty weather today")), (5, None), (6, ""), (7, say(30, "nаsty"))]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), lexicon).collect()}
    assert all(got[i] > 0.5 for i in (1, 3, 7)) and all(got[i] < 0.5 for i in (2, 4, 5, 6)) and got[5] == got[6] == got[2]
    assert toxicity.score(awkward[1], lexicon).count() == len(awkward[0]) and toxicity.score(nothing, lexicon).count() == 0
    blind = toxicity.learn(labelled(rows, "toxic")(spark).filter("toxic = 0"))
    assert blind.weights == {} and toxicity.score(awkward[1], blind).agg(F.max("score")).first()[0] < 0.5


VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 24))
    x = (centres[r.integers(0, 12, 3000)] + 0.4 * r.normal(size=(3000, 24))).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 0, 0.0, 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0, 0.0, 0), (5100, [0.0] * 24, 0, 0.0, 0), (5200, [float("nan")] * 24, 0, 0.0, 0), (5300, [None] * 24, 0, 0.0, 0), (5400, [1.0], 0, 0.0, 0), (None, x[0].tolist(), 0, 0.0, 0), rows[0], rows[100]]
    got = plain.grouped(hamming_ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect(), "query_id")
    assert sorted(got) == list(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        found = sorted(found, key=lambda f: f["rank"])
        assert [f["rank"] for f in found] == list(range(1, 11))
        assert all(abs(f["score"] - d[f["vec_id"]]) < 1e-12 for f in found)
        hits += len({f["vec_id"] for f in found} & set(want))
    assert hits >= 0.9 * 10 * len(got)
    ties = [f["vec_id"] for f in sorted(got[100], key=lambda f: f["rank"])]
    assert ties == list(range(101, 111))


def test_pigeonhole_finds_all_within_the_radius():
    codes = np.random.default_rng(2).integers(0, 2**16, (500, 4), dtype=np.uint16)
    queries = codes[:20] ^ np.uint16(5)
    for radius in (3, 9, 20, 64):
        for q, found in zip(queries, hamming_ann.Index(codes).within(queries, radius)):
            assert found.tolist() == np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius).tolist()


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 0.0, 0), (1, [0.0, 1.0], 0, 0.0, 0), (2, [-1.0, 0.5], 0, 0.0, 0)], VECTORS)
    got = hamming_ann.nearest(few, F.col("vec_id") % 2 == 0).collect()
    assert sorted((g["query_id"], g["rank"], g["vec_id"]) for g in got) == [(0, 1, 1), (0, 2, 2), (2, 1, 1), (2, 2, 0)]
    assert hamming_ann.nearest(few.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert hamming_ann.nearest(few.filter("vec_id = 0"), F.col("vec_id") % 2 == 0).count() == 0


def mixed_sources(spark, r, counts):
    rows = []
    for source, n in counts.items():
        rows += [(len(rows) + i, " ".join(["w"] * r.randrange(1, 40)), None, source) for i in range(n)]
    return rows, frame(spark, rows + [(9000, None, None, "big"), (9001, "", None, "none"), (None, "a b", None, "big"), rows[0]])


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    rows, docs = mixed_sources(spark, random.Random(9), {"big": 900, "mid": 200, "small": 60, None: 30})
    plan = mixing.planned(docs, entropy=0.95, repetitions=3.0)
    told = {r["source"]: r for r in plan.collect()}
    weights = np.array([r["weight"] for r in told.values() if r["tokens"]])
    assert abs(weights.sum() - 1) < 1e-9
    got = mixing.mixed(docs, plan)
    assert got.columns[:-2] == docs.columns
    tokens, times = Counter(), Counter()
    for row in got.collect():
        tokens[row["source"]] += len((row["text"] or "").split())
        times[row["doc_id"]] += 1
    for source, r in told.items():
        assert tokens[source] <= max(r["budget"], r["tokens"]) and tokens[source] > r["budget"] - 100
        assert tokens[source] >= r["tokens"] and r["budget"] <= 3.001 * r["tokens"]
    assert set(times) == {i for i, *_ in rows} | {9000, 9001, None}
    entropy = -(weights * np.log(weights)).sum() / np.log(len(weights))
    share = np.array([r["tokens"] for r in told.values() if r["tokens"]])
    share = share / share.sum()
    natural = -(share * np.log(share)).sum() / np.log(len(share))
    assert natural < entropy


def test_mixture_keeps_the_repetition_limit_and_takes_a_budget(spark):
    rows, docs = mixed_sources(spark, random.Random(10), {"big": 400, "small": 20})
    told = {r["source"]: r for r in mixing.planned(docs, entropy=1.0, repetitions=2.0).collect()}
    assert abs(told["small"]["budget"] / told["small"]["tokens"] - 2.0) < 0.01 and told["big"]["passes"] == 1
    plan = mixing.planned(docs, budget=1000)
    got = mixing.mixed(docs, plan).collect()
    total = sum(len((r["text"] or "").split()) for r in got)
    assert 850 <= total <= 1000 and max(Counter(r["doc_id"] for r in got).values()) <= 2


def test_mixture_of_nothing(nothing, spark):
    assert mixing.mixed(nothing, mixing.planned(nothing)).count() == 0
    silent = frame(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert mixing.mixed(silent, mixing.planned(silent)).count() == 2


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(12)
    texts = [t for t in plain.random_texts(r, 150)] + ["write to a@b.example.com now " + "w x y z " * 20]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == before.columns, name
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    dedup = spark.read.parquet(f"{tmp_path}/stage1").collect()
    given = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{tmp_path}/stage0").collect()]
    assert sorted(x["doc_id"] for x in dedup) == sorted(i for i, (_, c) in plain.components(given, 5, 80).items() if i == c)
    clean = spark.read.parquet(f"{tmp_path}/stage2").collect()
    assert len(clean) == len(dedup) and not any(plain.personal(x["text"]) for x in clean)
    assert {x["doc_id"] for x in docs.collect()} == {x["doc_id"] for x in clean}


def test_names_and_imports():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and ORACLE.keys() <= QUERIES.keys()
    for path in (ROOT / "ebbledger").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            named = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in named), path
