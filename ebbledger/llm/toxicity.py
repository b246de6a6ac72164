"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes case, accents, look-alike letters of other scripts and digits or
symbols put for letters out of the way and leaves words with single spaces. The
lexicon holds whole words and word beginnings with a weight each: the smoothed
log odds of their presence in toxic against other labelled documents, kept where
clear of chance. Where several terms match at one word the heaviest counts.
Exception phrases - a matched word with its neighbour, seen in clean documents
only, or given by the caller - cancel a match. A document's weight, taken per
word and in total, is turned into a score by a logistic curve fitted on labelled
documents.

Null and empty texts, or texts without letters, have no weight and get the score
of a document without matches. Without labels of both kinds there is no lexicon
and every score is the (smoothed) share of toxic labels. Rows stay one to one,
repeated rows included. Several labels of one document count each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger.llm.bpe import slices
from ebbledger.llm.common import text_rows

#: Lengths of word beginnings that can be terms.
STEMS = range(4, 8)
#: A term is kept when in this many toxic documents, and this many standard errors over chance.
LEAST_TOXIC, LEAST_Z = 5, 6.0
#: A phrase is an exception when in this many clean documents and in no toxic one.
LEAST_CLEAN = 3
#: Labelled documents that the lexicon is learned from, and those that the curve is fitted on, at most: they bound the lexicon too.
LEARN_DOCS, FIT_DOCS = 200_000, 20_000

#: Fixed: letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡһαβεικνορτυχ", "abekmhopctyxijsdghabeiknoptux")) | {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}
#: Fixed: digits and symbols that stand for letters inside words.
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_foreign = re.compile(r"[^\x00-\x7f]")
_standins = re.compile(r"[013457@$!|]+")
_between = re.compile(r"[\W\d_]+")
_letters: dict[str, str] = {}


def plain(letter: str) -> str:
    """A letter without accent and in Latin shape; invisible characters are nothing."""
    known = _letters.get(letter)
    if known is None:
        if unicodedata.category(letter) in ("Cf", "Mn"):
            known = ""
        else:
            known = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", letter).casefold() if unicodedata.category(c) != "Mn")
        _letters[letter] = known
    return known


def _is_letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and "a" <= text[at] <= "z"


def unmasked(run: re.Match) -> str:
    """A whole run of stand-ins as letters, looked at once however long it is.

    Before a letter all of it stands for letters, but for a mark that ends a word of
    two letters or more. Elsewhere only a digit right after a letter does, if no other follows.
    """
    text, found, begin, end = run.string, run[0], run.start(), run.end()
    if _is_letter(text, end):
        ends_word = found[0] in "!|" and _is_letter(text, begin - 1) and _is_letter(text, begin - 2)
        return found[:ends_word] + "".join([STANDINS[c] for c in found[ends_word:]])
    if found[0].isdigit() and _is_letter(text, begin - 1) and not "0" <= text[begin + 1 : begin + 2] <= "9":
        return STANDINS[found[0]] + found[1:]
    return found


def folded(text: str) -> str:
    """The text as lower-case words between single spaces, one at either end."""
    text = _foreign.sub(lambda m: plain(m[0]), text.lower())
    text = _standins.sub(unmasked, text)
    return f" {_between.sub(' ', text).strip()} "


def terms(words: set[str]) -> set[str]:
    """What a document can match: " word " for whole words, " stem" for beginnings."""
    found = {f" {w} " for w in words}
    for n in STEMS:
        found.update([" " + w[:n] for w in words if len(w) > n])
    return found


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    #: Intercept, and factors of the logarithms of total weight, weight per 100 words, and of the heaviest match.
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        found.make_automaton()
        return found


def matches(text: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, float]]:
    """Where words match in a folded text: place of the space before, heaviest weight."""
    at: dict[int, float] = {}
    if automaton is not None:
        for end, (length, weight) in automaton.iter(text):
            begin = end - length + 1
            if weight > at.get(begin, 0.0):
                at[begin] = weight
    return sorted(at.items())


def phrases(text: str, begin: int) -> tuple[str, str]:
    """The word at a place with the one before it, and with the one after it."""
    end = text.index(" ", begin + 1)
    before = text.rfind(" ", 0, begin) + 1 if begin else 0
    after = text.find(" ", end + 1)
    return text[before:end].strip(), text[begin + 1 : after if after > 0 else end].strip()


def measures(text: str, lexicon: Lexicon, automaton) -> tuple[float, float, float, int]:
    """Logarithms of total weight and of weight per 100 words; heaviest match; matches."""
    kept = [(b, w) for b, w in matches(text, automaton) if not lexicon.exceptions or not lexicon.exceptions.intersection(phrases(text, b))]
    total = sum(w for _, w in kept)
    return math.log1p(total), math.log1p(100 * total / max(20, text.count(" ") - 1)), max((w for _, w in kept), default=0.0), len(kept)


def learn(labelled: DataFrame, exceptions: frozenset[str] = frozenset()) -> Lexicon:
    """From doc_id, text, toxic: the lexicon, its exceptions and the curve of the score."""
    seen = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null")

    def counted(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 16_000_000):
                count: tuple[Counter, Counter] = Counter(), Counter()
                for text, toxic in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist()):
                    count[toxic > 0].update(terms(set(folded(text or "").split())))
                names = list(count[0] | count[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], ["term", "bad", "good"])

    totals = seen.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    bad, good = totals
    if not bad or not good:
        share = (bad + 1) / (bad + good + 2)
        return Lexicon({}, curve=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    p, q = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
    kept = (
        seen.mapInArrow(counted, "term string, bad long, good long")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") >= LEAST_TOXIC)
        .withColumn("weight", F.log(p / q))
        .withColumn("pool", (F.col("bad") + F.col("good")) / (bad + good))
        .withColumn("z", (F.col("bad") / bad - F.col("good") / good) / F.sqrt(F.col("pool") * (1 - F.col("pool")) * (1 / bad + 1 / good) + 1e-12))
        .filter((F.col("z") >= LEAST_Z) & (F.col("weight") > 1))
        .collect()
    )
    lexicon = Lexicon({row["term"]: row["weight"] for row in kept}, set(exceptions))

    def contexts(batches) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for piece in slices(batch, "text", 16_000_000):
                count: tuple[Counter, Counter] = Counter(), Counter()
                for text, toxic in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist()):
                    text = folded(text or "")
                    count[toxic > 0].update({x for b, _ in matches(text, automaton) for x in phrases(text, b) if " " in x})
                names = list(count[0] | count[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], ["phrase", "bad", "good"])

    clean = (
        seen.mapInArrow(contexts, "phrase string, bad long, good long")
        .groupBy("phrase")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter((F.col("bad") == 0) & (F.col("good") >= LEAST_CLEAN))
        .collect()
    )
    lexicon.exceptions |= {row["phrase"] for row in clean}
    numbers = measured(labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null"), lexicon, "toxic")
    sample = numbers.orderBy(F.xxhash64("doc_id"), "doc_id", "total", "share", "toxic").limit(FIT_DOCS)
    rows = np.array(sample.select("total", "share", "heaviest", "toxic").collect(), dtype=float)
    lexicon.curve = fitted(rows[:, :3], (rows[:, 3] > 0).astype(float))
    return lexicon


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, with a small ridge; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def measured(docs: DataFrame, lexicon: Lexicon, *more: str) -> DataFrame:
    """doc_id, the named columns, total, share, heaviest, n_matches of every text."""
    types = dict(docs.dtypes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [measures(folded(t or ""), lexicon, automaton) for t in piece.column("text").to_pylist()]
                columns = [pa.array([f[i] for f in found], pa.float64() if i < 3 else pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(piece.column(c) for c in more), *columns], ["doc_id", *more, "total", "share", "heaviest", "n_matches"])

    schema = ", ".join(f"{c} {t}" for c, t in [("doc_id", "long"), *((c, types[c]) for c in more), ("total", "double"), ("share", "double"), ("heaviest", "double"), ("n_matches", "long")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_matches for every row of docs."""
    a, *b = lexicon.curve
    power = F.lit(a) + b[0] * F.col("total") + b[1] * F.col("share") + b[2] * F.col("heaviest")
    return measured(text_rows(docs), lexicon).select("doc_id", (1 / (1 + F.exp(-power))).alias("score"), "n_matches")
