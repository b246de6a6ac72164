"""Operators on single texts and on copies, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import plain
from llm.conftest import frame

from ebbledger.llm import bytewise, near_dup, pii, quality_rules, suffix_dedup


def by_id(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_statistics(awkward, nothing):
    rows, docs = awkward
    df = quality_rules.statistics(docs).withColumn("failed", quality_rules.base_failed())
    got = by_id(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")
    assert got == sorted(((i, *plain.statistics(t)) for i, t, *_ in rows), key=str)
    assert quality_rules.statistics(nothing).count() == 0


def test_statistics_stay_native(awkward):
    plan = quality_rules.statistics(awkward[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_are_learned_in_order_and_kept_as_one_expression(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, 100, 500, r.randrange(80, 120) if bad and i % 2 else r.randrange(0, 20), 0, 10, 250 if bad and not i % 2 else r.randrange(5, 20), 0, 0, int(not bad)))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_upper long, n_marks long, n_repeat_words long, quality int")
    rules = quality_rules.learn(stats)
    assert 1 <= len(rules) <= quality_rules.MOST_RULES
    wrong = stats.withColumn("kept", quality_rules.verdict(rules)).filter("kept <> (quality = 1)").count()
    assert wrong <= 6  # a threshold is a quantile, not a gap
    assert quality_rules.learn(stats.filter("quality = 1")) == [] and quality_rules.learn(stats.limit(0)) == []
    assert stats.filter(~quality_rules.verdict([])).count() == 0


@pytest.mark.parametrize("length", [20, 400])
def test_repeated_strings(awkward, nothing, length):
    rows, docs = awkward
    found = suffix_dedup.repeated_strings(docs, length)
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, n: a + n)
    got = by_id(found.withColumn("gone", gone).withColumn("n", F.size("starts")), "n_bytes", "gone", "n", "kept_sha256")
    want = plain.without_repeats([t for _, t, *_ in rows], length)
    assert got == sorted(((row[0], *w) for row, w in zip(rows, want)), key=str)
    assert suffix_dedup.repeated_strings(nothing, length).count() == 0


def test_difference_covers():
    for most in (1, 13, 80, 200, 400):
        v, cover = suffix_dedup.difference_cover(most)
        assert v <= max(1, most) and {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_slices_of_many_texts(spark, monkeypatch):
    """Strings shared across slices and ranges, inside one text, and next to text ends."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 50)
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(0, 200))) + shared[r.randrange(0, 60) : r.randrange(90, 300)] + "".join(r.choice("xyz") for _ in range(r.randrange(0, 9))) for _ in range(60)] + ["ab" * 100]
    found = suffix_dedup.repeated_strings(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), 40)
    want = plain.without_repeats(texts, 40)
    assert by_id(found, "n_bytes", "kept_sha256") == sorted(((i, w[0], w[3]) for i, w in enumerate(want)), key=str)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, nothing, size, percent):
    texts = plain.random_texts(random.Random(size), 220) + ["", "  ", "one", "one", "ONE"]
    docs = frame(spark, [(3 * i, t, None, None) for i, t in enumerate(texts)] + [(900, None, None, None)])
    want = plain.components([(3 * i, t) for i, t in enumerate(texts)] + [(900, None)], size, percent)
    got = by_id(near_dup.near_duplicates(docs.repartition(6), size, percent), "n_shingles", "component_id", "kept")
    assert got == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=str)
    assert near_dup.near_duplicates(nothing, size, percent).count() == 0 and near_dup.deduplicated(nothing).count() == 0


def test_near_duplicates_of_awkward_rows(awkward):
    rows, docs = awkward
    got = near_dup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(rows)
    want = plain.components([(i, t) for i, t, *_ in rows if i is not None], 3, 85)
    assert all(r["component_id"] == want[r["doc_id"]][1] for r in got if r["doc_id"] is not None)
    anonymous = {r["component_id"] for r in got if r["doc_id"] is None}
    assert anonymous == {want[3][1], None}
    kept = near_dup.deduplicated(docs, 3, 85)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(i for i in want if want[i][1] == i)


def test_a_hub_is_not_enough(spark):
    """A chain of near copies, each like the next one only, is one component."""
    r = random.Random(1)
    found = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(found), None, None))
        for _ in range(3):
            found[r.randrange(200)] = f"n{i}-{r.random()}"
    got = near_dup.near_duplicates(frame(spark, rows), 3, 85).select("component_id").distinct().collect()
    want = {c for _, c in plain.components([(i, t) for i, t, *_ in rows], 3, 85).values()}
    assert {g[0] for g in got} == want


def test_least_equal_bounds_the_miss():
    for n in (16, 32, 76):
        m = near_dup.least_equal(n, 0.85)
        draws = np.random.default_rng(0).binomial(n, 0.85, 200_000)
        assert (draws < m).mean() < 1e-4
    assert near_dup.least_equal(16, 1.0) == 16


AWKWARD_DATA = [
    "mail me: a.b+c@x-y.co.uk. or a@b", "a@b.c.@d.e_f@g.h", "@@ a@@b.c x@y..z", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111x", "+1 (017) 555-7713 +12 +1234567 ++1 234 567 89 .",
    "1" * 40, "ü@a.b é1.2.3.4 🙂+49 30 1234567🙂a@b.c", "1 " * 5000, "a" * 20000 + "@", "1." * 4000, "+" * 3000 + "1 2 3 4 5 6 7 8", "1-" * 9000 + "a@b.c",
]


def test_personal_data(spark, awkward, nothing):
    rows = [(i, t, None, None) for i, t in enumerate(AWKWARD_DATA)] + [(99, None, None, None), (None, "a@b.c", None, None), (1, AWKWARD_DATA[1], None, None)]
    for given, docs in ((rows, frame(spark, rows)), awkward):
        got = {r["doc_id"]: r for r in pii.report(pii.personal_data(docs)).collect()}
        for i, text, *_ in given:
            if i is None:
                continue
            want = plain.personal(text)
            listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert (got[i]["base_sha256"], got[i]["spans"]) == (hashlib.sha256(listed.encode()).hexdigest(), listed), text[:60]
            assert [got[i][f"n_{k}"] for k in plain.PATTERNS] == [sum(x[0] == k for x in want) for k in plain.PATTERNS]
    assert pii.report(pii.personal_data(nothing)).count() == 0


def test_contexts_lead_to_new_identifiers(spark):
    r = random.Random(2)
    rows = [(i, f"text {i} of words customer-mail: user{i}@mail.example.com and more", None, None) for i in range(40)]
    rows += [(100 + i, f"some other customer-mail: AB-{r.randrange(10**6):06d} here", None, None) for i in range(5)]
    rows += [(200 + i, f"the number of AB-{r.randrange(10**6):06d} is the same of all", None, None) for i in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.personal_data(frame(spark, rows))).collect()}
    assert all(got[100 + i] == "other:26:35" for i in range(5))
    assert all(got[200 + i] == "" for i in range(5)) and all(got[i].startswith("email:") and "other" not in got[i] for i in range(40))


def test_redacted(spark, awkward):
    rows = [(1, "a@b.c, then 1.2.3.4 ü", None, None), (2, None, None, None), (3, "card 4111 1111 1111 1111", None, None), (4, "clean", None, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redacted(frame(spark, rows)).collect()}
    assert got[1] == ("<email>, then <ip> ü", 20) and got[2] == (None, 0) and got[4] == ("clean", 5)
    assert "4111" not in got[3][0]
    assert pii.redacted(awkward[1]).count() == len(awkward[0]) and pii.redacted(awkward[1]).columns == awkward[1].columns


def test_byte_hashes():
    data = np.frombuffer(b"abc abd abc xabc", np.uint8)
    begin, end = bytewise.words(data)
    h = bytewise.Hashes(data).of(begin, end)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    two, owner = bytewise.shingles(h, np.array([0, 0, 1, 1]), 2)
    assert len(two) == 2 and owner.tolist() == [0, 1]
    alone, _ = bytewise.shingles(h[:1], np.array([0]), 2)
    assert len(alone) == 1
