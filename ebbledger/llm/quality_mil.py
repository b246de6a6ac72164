"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of about `PASSAGE` bytes, cut at white space,
and every passage of the whole text counts. A passage is described by the
frequencies of pairs of neighbouring byte classes, its words' lengths and
repetitions, and encoded by a small learned layer. Gated attention weighs the
passages, and a logistic unit scores the weighted sum. All weights are learned
together from document labels alone, on a bounded sample, with a fixed seed.

Null texts, empty texts and texts without a word are one empty passage, scored
like any other. Ties in the sample's hash order go to the smaller doc_id. Without
labels every score is 0.5; with labels of one kind it is their smoothed share.
Rows stay one to one, repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbledger.llm import bytewise
from ebbledger.llm.bpe import slices
from ebbledger.llm.common import text_rows

PASSAGE = 600
#: The sample that is learned from: documents, and evenly spaced passages of each, at most.
FIT_DOCS, FIT_PASSAGES = 6_000, 48
HIDDEN, GATES, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 25, 64, 0.01, 1e-4, 7

CLASSES = np.full(256, 15, np.uint8)
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"'\"-():;", b"#*", b"$%&", b"|<>", b"/\\_=+@~^`[]{}"]):
    CLASSES[list(_chars)] = _k
CLASSES[128:192], CLASSES[192:] = 13, 14
FEATURES = 256 + 5


def described(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the number of passages of each text."""
    data, begins = bytewise.joined([(t or "").encode() for t in texts])
    if not len(texts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    begin, end = bytewise.words(data)
    doc = np.searchsorted(begins, begin, "right") - 1
    hashes = bytewise.Hashes(data).of(begin, end)
    step = (begin - begins[doc]) // PASSAGE  # a word belongs to the passage it begins in
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (step[1:] != step[:-1]))) if len(doc) else np.zeros(0, bool)
    firsts = np.flatnonzero(new)
    passage = np.cumsum(new) - 1
    n = np.bincount(doc[firsts], minlength=len(texts))
    rows = len(firsts)
    x = np.zeros((rows, FEATURES), np.float32)
    if rows:
        starts = begin[firsts]
        of_byte = np.searchsorted(starts, np.arange(len(data)), "right") - 1
        kinds = CLASSES[data].astype(np.int64)
        pair = kinds[:-1] * 16 + kinds[1:]
        # Pairs of one text alone: not its end with the next one's beginning, nor what stands before its first word.
        tops = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        first = begins[1:].copy()
        first[doc[tops]] = begin[tops]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, begins[:-1], 1)
        np.add.at(edge, first, -1)
        inside = np.cumsum(edge[:-2]) == 0
        inside[begins[1:-1] - 1] = False
        counts = np.bincount(of_byte[:-1][inside] * 256 + pair[inside], minlength=rows * 256).reshape(rows, 256)
        x[:, :256] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
        words = np.bincount(passage, minlength=rows).astype(np.float32)
        length = np.bincount(passage, weights=end - begin, minlength=rows) / words
        _, one = np.unique(bytewise.mixed(hashes + passage.astype(np.uint64) * bytewise.BASE), return_index=True)
        distinct = np.bincount(passage[one], minlength=rows)
        h, owner = bytewise.shingles(hashes, doc, 5)
        _, seen = np.unique(bytewise.mixed(h + owner.astype(np.uint64) * bytewise.BASE), return_index=True)
        again = np.ones(len(h), bool)
        again[seen] = False
        sizes = np.diff(np.append(tops, len(doc)))
        place = np.repeat(np.arange(len(tops)), np.maximum(1, sizes - 4))
        within = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(np.maximum(1, sizes - 4))[:-1])), np.maximum(1, sizes - 4))
        repeated = np.bincount(passage[tops[place] + within], weights=again, minlength=rows)
        x[:, 256] = distinct / words
        x[:, 257] = repeated / words
        x[:, 258] = np.log1p(length) / 3
        x[:, 259] = np.log1p(words) / 5
        x[:, 260] = np.log1p(np.repeat(n[n > 0], n[n > 0])) / 5
    if (n == 0).any():  # an empty passage each
        x = np.insert(x, np.cumsum(n)[n == 0], 0.0, axis=0)
        n = np.maximum(n, 1)
    return x, n


@dataclass
class Model:
    p: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["w"] + self.p["b"])

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.encoded(x)
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n))
        e /= np.repeat(np.add.reduceat(e, begin), n)
        z = np.add.reduceat(e[:, None] * h, begin, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "e": e, "z": z, "score": score}

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, o = self.p, self.forward(x, n)
        begin, bag = np.concatenate(([0], np.cumsum(n)[:-1])), np.repeat(np.arange(len(n)), n)
        up = (o["score"] - y) / len(y)
        dz = up[:, None] * p["c"]
        de = (dz[bag] * o["h"]).sum(1)
        ds = o["e"] * (de - np.add.reduceat(o["e"] * de, begin)[bag])
        gate = ds[:, None] * p["a"]
        dt, du = gate * o["s"] * (1 - o["t"] ** 2), gate * o["t"] * o["s"] * (1 - o["s"])
        dh = (o["e"][:, None] * dz[bag] + dt @ p["v"].T + du @ p["u"].T) * (1 - o["h"] ** 2)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": o["h"].T @ dt, "u": o["h"].T @ du, "a": (o["t"] * o["s"]).T @ ds, "c": o["z"].T @ up, "d": up.sum(keepdims=True)}


def trained(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Model:
    """Adam over shuffled groups of documents."""
    r = np.random.default_rng(SEED)
    shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "d": (1,)}
    model = Model({k: r.normal(0, s[0] ** -0.5, s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()})
    share = (y.sum() + 1) / (len(y) + 2)
    model.p["d"][:] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(y))
            for i in range(0, len(y), BATCH):
                docs = order[i : i + BATCH]
                rows = np.concatenate([np.arange(begin[d], begin[d] + n[d]) for d in docs])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in model.gradients(x[rows].astype(float), n[docs], y[docs]).items():
                    g = g + DECAY * model.p[k] * (k not in "bd")
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    else:
        model.p["c"][:] = 0.0
    return model


def learn(labelled: DataFrame) -> Model:
    """From doc_id, text, quality: a model, learned on the first FIT_DOCS rows in the order of a hash."""

    def bags(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                x, n = described(piece.column("text").to_pylist())
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                kept = [x[b + np.unique(np.linspace(0, k - 1, min(k, FIT_PASSAGES)).astype(int))] for b, k in zip(begin, n)]
                yield pa.RecordBatch.from_arrays([piece.column("quality"), pa.array([len(k) for k in kept], pa.int32()), pa.array([k.astype(np.float32).tobytes() for k in kept], pa.binary())], ["quality", "n", "bag"])

    sample = labelled.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).filter("quality is not null").orderBy(F.xxhash64("text"), "doc_id").limit(FIT_DOCS)
    rows = sample.select("text", "quality").mapInArrow(bags, "quality int, n int, bag binary").collect()
    if not rows:
        return trained(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0))
    x = np.concatenate([np.frombuffer(row["bag"], np.float32) for row in rows]).reshape(-1, FEATURES)
    return trained(x, np.array([row["n"] for row in rows]), np.array([float(row["quality"] > 0) for row in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages, and the place and weight of the passage with most attention, for every row of docs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                x, n = described(piece.column("text").to_pylist())
                o = model.forward(x, n)
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                top = [int(np.argmax(o["e"][b : b + k])) for b, k in zip(begin, n)]
                weight = [float(o["e"][b + t]) for b, t in zip(begin, top)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(o["score"], pa.float64()), pa.array(n, pa.int32()), pa.array(top, pa.int32()), pa.array(weight, pa.float64())], ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    return text_rows(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double, n_passages int, top_passage int, top_weight double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs that score `least` or more, filtered where they are read: no join back to the texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 500_000):
                x, n = described(piece.column("text").to_pylist())
                yield piece.filter(pa.array(model.forward(x, n)["score"] >= least))

    return docs.mapInArrow(run, docs.schema)
