"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones.

Everything is Spark SQL expressions. `statistics` measures every text. `learn`
grows rules by sequential covering: starting from all rows still uncovered, it
adds the threshold condition with the best gain of information until a rule is
pure or nothing helps, drops the last conditions again while that does not hurt
on rows held back, and then covers the rest. Each step is one aggregation of
labelled statistics into counts for each feature and bin; only those counts, whose
number does not depend on the data, reach the driver. `verdict` gives the list as
one ordered Spark conditional expression.

A null text has no words, like an empty one: all counts are 0. Without labels of
both kinds no rule is learned and the list keeps everything. Equal gains go to the
feature named first, then to the smaller threshold. Rows stay one to one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbledger.llm.common import SPACE, stored, text_rows

#: Window of the repetition count, in words.
WINDOW = 8
#: Quantiles tried as thresholds of each feature; rules; conditions of a rule.
BINS, MOST_RULES, MOST_CONDITIONS = 40, 8, 3
#: A rule must be this pure on rows held back, and cover so many of the bad ones there.
LEAST_PURE, LEAST_COVERED = 0.9, 2

#: What rules look at: name and expression over the statistics.
FEATURES = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "marks_per_char": "n_marks / greatest(word_chars, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def without(text: Column, pattern: str) -> Column:
    """How many characters a pattern of single characters takes."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def joined_with(column: str, step: int):
    """Hash of an element of an array and of the one `step` further."""
    return lambda x, i: F.xxhash64(x, F.get(F.col(column), i + step))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text.

    Windows are compared by 64-bit hashes made in three doublings, within one text.
    Where some are equal, they are sorted with their places, and the words covered
    follow from the gaps between the places of repeated windows.
    """
    text, words = F.coalesce("text", F.lit("")), F.col("words")
    df = text_rows(docs).select("doc_id", text.alias("text"))
    df = df.select(
        "doc_id",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        without(F.col("text"), "[#*$%&|<>]+").alias("n_symbols"),
        without(F.col("text"), "[A-Z]+").alias("n_upper"),
        without(F.col("text"), "[!?]+").alias("n_marks"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks"]
    df = df.select(
        "*",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("h1"),
    ).select("doc_id", *counts, "h1")
    for step in (1, 2, 4):  # hashes of 2, 4, 8 words in a row
        old, new = f"h{step}", f"h{2 * step}"
        shorter = F.slice(F.col(old), F.lit(1), F.greatest(F.size(old) - step, F.lit(0)))
        df = df.withColumn(new, F.transform(shorter, joined_with(old, step))).select("doc_id", *counts, new)
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    placed = F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("sorted", F.when(some, F.sort_array(placed))).select("doc_id", *counts, "sorted")
    s = F.col("sorted")
    same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    places = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
    df = df.withColumn("places", places).select("doc_id", *counts, "places")
    p = F.col("places")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in [*counts, "n_repeat_words"]))


def base_failed() -> Column:
    """The fixed rules: fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature at least (or under) a threshold."""

    feature: str
    above: bool
    threshold: float
    bin: int

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.threshold!r}D"

    def of_bins(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bin}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def sql(self) -> str:
        return " AND ".join(f"({c.sql()})" for c in self.conditions)


def binned(labelled: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """The labelled statistics with each feature as the number of its thresholds reached, stored; the thresholds."""
    values = labelled.select("doc_id", (F.col("quality") <= 0).alias("bad"), *(F.expr(e).alias(f) for f, e in FEATURES.items())).filter("bad is not null")
    quantiles = [i / BINS for i in range(1, BINS)]
    row = values.agg(*(F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES)).first()
    # bad rows are few: their own quantiles give the thresholds near them
    few = values.filter("bad").agg(*(F.percentile_approx(f, quantiles, 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({*(row[f] or []), *(few[f] or [])}) for f in FEATURES}
    bins = [(F.expr(" + ".join(f"cast({f} >= {c!r}D as int)" for c in cuts[f])) if cuts[f] else F.lit(0)).alias(f) for f in FEATURES]
    return stored(values.select("bad", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 0).alias("grow"), *bins), "binned"), cuts


def grown(rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    """Conditions that lead to a pure rule on the rows, each the best next step."""
    found: list[Condition] = []
    while len(found) < MOST_CONDITIONS:
        on = rows.filter(" and ".join(c.of_bins() for c in found)) if found else rows
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES))).alias("x")
        counts = on.select("bad", pairs).groupBy("x.feature", "x.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        by = {f: sorted((r["bin"], r["bad"], r["good"]) for r in counts if r["feature"] == f) for f in FEATURES}
        bad, good = (sum(x[k] for x in by["words"]) for k in (1, 2))
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for feature, bins in by.items():
            p = n = 0
            for at, (b, more_bad, more_good) in enumerate(bins[:-1]):
                p, n = p + more_bad, n + more_good
                for above, (x, y) in ((True, (bad - p, good - n)), (False, (p, n))):
                    if x and (value := x * (math.log2(x / (x + y)) - math.log2(bad / (bad + good)))) > gain:
                        best, gain = Condition(feature, above, cuts[feature][b], b), value
        if best is None:
            break
        found.append(best)
    return found


def learn(labelled: DataFrame) -> list[Rule]:
    """From statistics with a column quality (0: bad): rules that find bad rows, in order."""
    rows, cuts = binned(labelled)
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        found = grown(rows.filter("grow"), cuts)
        if not found:
            break
        held = rows.filter("not grow")
        tests = [" and ".join(c.of_bins() for c in found[: k + 1]) for k in range(len(found))]
        row = held.agg(*(F.count_if(F.expr(t) & F.col("bad")).alias(f"b{k}") for k, t in enumerate(tests)), *(F.count_if(F.expr(t) & ~F.col("bad")).alias(f"g{k}") for k, t in enumerate(tests))).first()
        worth = [(row[f"b{k}"] - row[f"g{k}"]) / max(1, row[f"b{k}"] + row[f"g{k}"]) for k in range(len(found))]
        k = worth.index(max(worth))
        bad, good = row[f"b{k}"], row[f"g{k}"]
        if bad < LEAST_COVERED or bad < LEAST_PURE * (bad + good):
            break
        rules.append(Rule(tuple(found[: k + 1]), bad, good))
        rows = rows.filter(f"not ({tests[k]})")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the first rule that holds rejects; none keeps."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def fired(rules: list[Rule]) -> Column:
    """The number of the rule that rejects, from 1; null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {k}" for k, r in enumerate(rules, 1)) + " END").cast("int")
