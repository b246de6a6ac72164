"""The registered queries on tables of their own, with clashing columns, against plain scoring; empty tables; long texts."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from llm import plain
from llm.conftest import frame

from ebbledger.llm import langid, mixing, pii, quality_mil, toxicity
from ebbledger.llm.common import labelled
from ebbledger.llm.queries import QUERIES

WORDS = {"aa": "ka lo mi ru te na so word".split(), "bb": "zur blik drom stef knal word".split()}


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def texts_of(r, n):
    """Rows of (id, text, lang, source) and their labels: bad ones are full of signs, toxic ones hold a word."""
    rows, labels = [], []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        own = [r.choice(WORDS[lang]) for _ in range(r.randrange(25, 120))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            own += [r.choice(["BUY###", "NOW***", "|", "$$$"]) for _ in range(60)]
        if toxic:
            own.insert(r.randrange(len(own)), r.choice(["nasty", "nastier", "v1le", "vile"]))
        r.shuffle(own)
        rows.append((i, " ".join(own), lang, f"s{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, "aa", None), (n + 1, "", None, "s0"), (n + 2, "12 34 ...", "bb", "s1"), (n + 3, " ".join(WORDS["bb"] * 4000), "bb", "s1"), rows[0], (None, "ka lo mi", "aa", "s0")]
    return rows, labels


def write(spark, root, rows, labels, vectors=()):
    frame(spark, rows).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, t, 1, "x") for i, q, t in labels], "doc_id long, quality int, toxic int, score int, text string").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(i, t, "x") for i, t, *_ in rows[:5] if i is not None], "item_id long, text string, term string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def made():
    return texts_of(random.Random(21), 420)


@pytest.fixture(scope="module")
def folder(spark, made, tmp_path_factory):
    r = np.random.default_rng(2)
    vectors = [(i, r.normal(size=16).astype(float).tolist()) for i in range(300)]
    return write(spark, str(tmp_path_factory.mktemp("tables")), *made, vectors)


def changed(labels, column, held):
    """Labels of the held-out fold turned round; the others as they are."""
    return [tuple(1 - v if k == column and held(row[0]) else v for k, v in enumerate(row)) for row in labels]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op3_is_the_forward_pass(spark, made, folder, tmp_path):
    rows, labels = made
    df = QUERIES["op3_quality_classifier"](spark, folder).select("doc_id", "held_out", "score", "predicted")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = spark.createDataFrame([(i, q) for i, q, _ in labels if fold(i, 4) != 2], "doc_id long, quality int")
    model = quality_mil.learn(labelled(docs, known, "quality", quality_mil.FIT_DOCS))
    want = []
    for i, text, *_ in rows:
        x, n = quality_mil.described([text])
        h = np.tanh(x @ model.p["w"] + model.p["b"])
        gate = np.tanh(h @ model.p["v"]) / (1 + np.exp(-(h @ model.p["u"])))
        weight = np.exp(gate @ model.p["a"])
        score = 1 / (1 + math.exp(-float((weight / weight.sum()) @ h @ model.p["c"] + model.p["d"][0])))
        want.append((i, i is not None and fold(i, 4) == 2, score))
    got = df.collect()
    assert Counter((g.doc_id, g.held_out, round(g.score, 6)) for g in got) == Counter((i, h, round(s, 6)) for i, h, s in want)
    assert all(g.predicted == (g.score >= 0.7) for g in got)
    right = [g.predicted == dict((i, q) for i, q, _ in labels)[g.doc_id] for g in got if g.held_out and g.doc_id < 420]
    assert sum(right) >= 0.95 * len(right) > 50
    other = write(spark, str(tmp_path / "other"), rows, changed(labels, 1, lambda i: fold(i, 4) == 2))
    assert rows_of(QUERIES["op3_quality_classifier"](spark, other).select(df.columns)) == rows_of(df)


def plain_toxicity(text, lexicon):
    """Every word against every term, one by one."""
    words = re.findall(r"[^ ]+", toxicity.folded(text or ""))
    found = []
    for k, word in enumerate(words):
        fits = [w for term, w in lexicon.weights.items() if (term == f" {word} " if term.endswith(" ") else word.startswith(term[1:]))]
        beside = {" ".join(words[max(0, k - 1) : k + 1]), " ".join(words[k : k + 2])}
        if fits and not beside & lexicon.exceptions:
            found.append(max(fits))
    total = sum(found)
    a, b, c, d = lexicon.curve
    return 1 / (1 + math.exp(-(a + b * math.log1p(total) + c * math.log1p(100 * total / max(20, len(words))) + d * max(found, default=0.0))))


def test_op6_is_the_lexicon(spark, made, folder, tmp_path):
    rows, labels = made
    df = QUERIES["op6_toxicity"](spark, folder).select("doc_id", "held_out", "score", "predicted")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = spark.createDataFrame([(i, t) for i, _, t in labels if fold(i, 5) != 0], "doc_id long, toxic int")
    lexicon = toxicity.learn(labelled(docs, known, "toxic", toxicity.LEARN_DOCS))
    want = Counter((i, i is not None and fold(i, 5) == 0, round(plain_toxicity(text, lexicon), 9)) for i, text, *_ in rows)
    got = df.collect()
    assert Counter((g.doc_id, g.held_out, round(g.score, 9)) for g in got) == want
    assert all(g.predicted == (g.score >= 0.5) for g in got)
    right = [g.predicted == dict((i, t) for i, _, t in labels)[g.doc_id] for g in got if g.held_out and g.doc_id < 420]
    assert sum(right) >= 0.95 * len(right) > 50
    other = write(spark, str(tmp_path / "other"), rows, changed(labels, 2, lambda i: fold(i, 5) == 0))
    assert rows_of(QUERIES["op6_toxicity"](spark, other).select(df.columns)) == rows_of(df)


def test_op8_is_the_smallest_size(spark, made, folder, tmp_path):
    rows, _ = made
    df = QUERIES["op8_language_id"](spark, folder)
    learned = spark.read.parquet(f"{folder}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = langid.dictionaries(learned)
    by = {}
    for lang, own in known.items():
        held = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=langid.LEVEL)
        by[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
    for g in df.collect():
        assert g.held_out == (g.doc_id is not None and fold(g.doc_id, 5) == 0)
        texts = {t for i, t, *_ in rows if i == g.doc_id}
        text = texts.pop() or ""
        if not re.search("[a-z]", text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        data = text.lower().encode()
        size = {lang: sum(len(c.compress(data[k : k + langid.BLOCK])) for k in range(0, len(data), langid.BLOCK)) for lang, c in by.items()}
        first, second = sorted(size.values())
        assert size[g.lang_pred] == first and g.score == pytest.approx(1 - first / second)
    right = [g.lang_pred == ("aa", "bb")[g.doc_id % 2] for g in df.collect() if g.doc_id is not None and g.doc_id < 420]
    assert sum(right) >= 0.98 * len(right)
    other = [(i, t, "aa" if i is not None and fold(i, 5) == 0 else lang, s) for i, t, lang, s in rows]
    folder2 = write(spark, str(tmp_path / "other"), other, [])
    assert rows_of(QUERIES["op8_language_id"](spark, folder2)) == rows_of(df)


def test_language_samples_come_from_everywhere(spark):
    """A text's end is learned from like its beginning; copies of one text do not crowd out the others; bounds hold."""
    r = random.Random(3)
    late = "ka " * 3000 + " ".join(r.choice(["zq", "qz", "zzq"]) for _ in range(2000))
    rows = [(0, late, "aa", None)] + [(1 + i, "one and the same", "aa", None) for i in range(2000)] + [(9000 + i, f"b {r.random()} b", "bb", None) for i in range(3000)]
    known = langid.dictionaries(frame(spark, rows), samples=50, size=9_000)
    assert b"zzq" in known["aa"] and b"one and the same" in known["aa"] and known["aa"].count(b"one and the same") == 1
    assert known["bb"].count(b"\n") == 49 and all(len(d) <= 9_000 for d in known.values())
    assert langid.last_hash(10, 50) == 2**63 - 1 and langid.last_hash(100, 50) == 0


def test_op1_keeps_nothing_that_the_base_rule_fails(spark, made, folder):
    got = QUERIES["op1_quality_rules"](spark, folder).collect()
    want = Counter((i, *plain.statistics(t)) for i, t, *_ in made[0])
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got) == want
    assert all(not g.kept for g in got if g.base_failed) and any(g.kept for g in got)


def test_op2_and_op9_and_op10_on_the_folder(spark, made, folder):
    rows = made[0]
    got = QUERIES["op2_suffix_dedup"](spark, folder).collect()
    want = Counter((row[0], *w) for row, w in zip(rows, plain.without_repeats([t for _, t, *_ in rows], 400)))
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == want
    got = QUERIES["op9_minhash_near_dup"](spark, folder).where("doc_id is not null").collect()
    parts = plain.components([(i, t) for i, t, *_ in rows if i is not None], 3, 85)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == parts and all(g.kept == (g.doc_id == g.component_id) for g in got)
    got = QUERIES["op10_pii"](spark, folder).collect()
    assert len(got) == len(rows) and Counter(g.doc_id for g in got) == Counter(i for i, *_ in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    root = write(spark, str(tmp_path / "none"), [], [])
    assert QUERIES[name](spark, root).count() == 0


def test_runs_of_stand_ins_fold_as_one_by_one():
    """The rule for each sign alone, which looks ahead over the whole run, on short texts."""
    one = re.compile(r"[013457@$!|](?=[013457@$!|]*[a-z])(?<![a-z]{2}[!|])|(?<=[a-z])[013457](?![0-9])")
    r = random.Random(8)
    for _ in range(20_000):
        text = "".join(r.choice("ab013457@$!|269 .") for _ in range(r.randrange(1, 12)))
        assert toxicity._standins.sub(toxicity.unmasked, text) == one.sub(lambda m: toxicity.STANDINS[m[0]], text), text


def test_long_runs_take_time_in_proportion():
    begin = time.perf_counter()
    assert len(toxicity.folded("1" * 1_000_000 + " " + "5" * 1_000_000 + "a")) == 1_000_003
    assert time.perf_counter() - begin < 10


def mails(n):
    return " ".join(f"user{i}@example.org and +1 (555) 010-{i % 10000:04d} or 10.0.0.{i % 256} ref AB-{i}-77" for i in range(n))


def test_many_spans_take_time_in_proportion(spark):
    """Thousands of spans in one text: places, overlaps and redaction are right, and ten times the text is not a hundred times the time."""
    seconds = {}
    for n in (400, 4_000):
        docs = frame(spark, [(1, mails(n), None, None)])
        begin = time.perf_counter()
        row = pii.report(pii.personal_data(docs)).first()
        assert (row.n_email, row.n_phone, row.n_ip) == (n, n, n)
        base = sorted(f"{k}:{a}:{b}" for k, a, b in plain.personal(mails(n)))
        assert sorted(s for s in row.spans.split(",") if not s.startswith("other")) == base
        shown = pii.redacted(docs).first()
        assert shown.text.count("<email>") == n and "@" not in shown.text and shown.n_chars == len(shown.text)
        seconds[n] = time.perf_counter() - begin
    assert seconds[4_000] < 25 * max(1.0, seconds[400])


def test_redaction_across_pieces_of_a_text(spark, monkeypatch):
    """The same text, whatever the length of pieces that it is put together from, with signs beyond the first plane."""
    text = "🙂" * 30 + " " + mails(9) + " ünd " + "x" * 60 + " a@b.cd"
    docs = frame(spark, [(1, text, None, None), (2, "a@b.cd", None, None), (3, "nothing", None, None), (4, None, None, None)])
    want = rows_of(pii.redacted(docs).select("doc_id", "text", "n_chars"))
    for piece, part in ((1, 1), (7, 2), (64, 3)):
        monkeypatch.setattr(pii, "PIECE", piece)
        monkeypatch.setattr(pii, "PART", part)
        assert rows_of(pii.redacted(docs).select("doc_id", "text", "n_chars")) == want
    assert want[1][1] == "<email>" and want[3] == (4, None, 0)


def test_stages_leave_columns_of_any_name_alone(spark):
    """Columns with the names that the operators use inside."""
    rows = [(i, f"a{i}@b.cd text", "en", f"s{i % 2}") for i in range(40)]
    names = ["_row", "marked", "row", "doc", "pieces", "changed", "gone", "_plan", "_key", "_block", "_epoch", "plan", "key2", "source2"]
    docs = frame(spark, rows).select("*", *(F.col("doc_id").alias(n) for n in names))
    for out in (pii.redacted(docs), mixing.mixed(docs, mixing.planned(docs), numbered=False)):
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{n}` <> doc_id" for n in names)).count() == 0 and out.select("doc_id").distinct().count() == 40
    with pytest.raises(ValueError, match="_block"):
        mixing.mixed(docs, mixing.planned(docs))
