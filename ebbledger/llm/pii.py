"""Personal data in texts: base patterns, and identifiers found by bootstrapping on their contexts.

All of it is Spark SQL expressions. Base spans come from four patterns with checks.
Every text is cut by a pattern once; the lengths of pieces and matches give code
point places, and the pieces give the words before and after a match.

Bootstrapping: base matches are seed instances. The word before and the word after
a match are its lexical patterns. A pattern's confidence is the sum of scores of
the instances in its slot over all occurrences of its word in the corpus; an
instance's score is 1 for seeds and else the best confidence of its patterns.
Confidence and scores are passed to and fro over the pattern-instance graph for
some rounds. Tokens with digits that stand in the slot of a pattern of high
confidence and enough different seeds, and touch no base span, are added with the
kind `other`; base spans stay as they are.

A null text is an empty one, without spans. Repeated rows count each in the corpus
counts and get the same spans. Order of spans: by kind as in KINDS, then by start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbledger.llm.common import SPACE, stored, text_rows

#: Fixed: the base patterns. Possessive repeats and the look-behinds change no match: they keep the search linear
#: where a run of letters or digits is very long.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth a search.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "other"]
#: A token with a digit; only those with this length and number of digits or more are candidates.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
CANDIDATE = "length(m) >= 6 and length(regexp_replace(m, '[^0-9]', '')) >= 3"
#: Bootstrapping: rounds, confidence needed, and different seeds that a pattern must have had.
ROUNDS, CONFIDENT, LEAST_SEEDS = 3, 0.6, 5

_digits = "regexp_replace(m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": r"m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.(?!$)|$)){4}$'",
    "card": f"length({_digits}) between 16 and 19 and aggregate(transform(split({_digits}, ''), (d, i) -> "
    f"if((length({_digits}) - i) % 2 = 1, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))), 0, (a, d) -> a + d) % 10 = 0",
    "phone": f"length({_digits}) between 8 and 15",
}

#: Elements of an array that are gone through together, and characters of a piece of text: what takes a step for
#: each pair of elements, or counts characters from the start, stays inside such a part.
PART, PIECE = 512, 4_096

SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def parts(name: str) -> str:
    """An array in parts, none for an empty one."""
    return f"if(size({name}) > 0, transform(sequence(0, size({name}) - 1, {PART}), p -> slice({name}, p + 1, {PART})), array())"


def running(name: str, values: str, step: str) -> list[dict[str, Column]]:
    """Steps of columns that end in column `name`: for each of an array of whole numbers what step (of x, the one so far, and y) makes of those before it, from 0."""
    last = "element_at(s, -1)"
    onto = step.replace("x", last)
    return [
        {f"{name}_v": F.expr(values)},
        {f"{name}_p": F.expr(parts(f"{name}_v"))},
        {f"{name}_f": F.expr(f"aggregate({name}_p, array(0), (s, p) -> concat(s, array(aggregate(p, {last}, (x, y) -> {step}))))")},
        {name: F.expr(f"flatten(transform({name}_p, (p, k) -> slice(aggregate(p, array({name}_f[k]), (s, y) -> concat(s, array({onto}))), 1, size(p))))")},
    ]


def spans(kind: str, pattern: str, valid: str, needs: str | None) -> list[dict[str, Column]]:
    """Steps of columns that end in column `kind`: valid matches with place, text and neighbours."""
    has = F.lit(True) if needs is None else F.contains("text", F.lit(needs))
    found, cut, at = f"{kind}_m", f"{kind}_p", f"{kind}_at"
    plain = lambda text: rf"translate({text}, '\t\n\u000B\f\r', '     ')"
    left = f"if(i > 0, concat({found}[i - 1], {cut}[i]), {cut}[i])"
    walk = (
        f"flatten(transform({at}, (a, i) -> transform(filter(array({found}[i]), m -> {valid}), m -> named_struct("
        f"'start', a + length({cut}[i]), 'end', a + length({cut}[i]) + length(m), 'm', m, "
        f"'before', lower(substring_index(rtrim({plain(left)}), ' ', -1)), "
        f"'after', lower(substring_index(ltrim({plain(f'{cut}[i + 1]')}), ' ', 1))))))"
    )
    return [
        {found: F.coalesce(F.when(has, F.regexp_extract_all("text", F.lit(pattern), 0)), F.expr("cast(array() as array<string>)"))},
        {cut: F.when(F.size(found) > 0, F.split("text", pattern, -1))},
        *running(at, f"transform({found}, (m, i) -> length(m) + length({cut}[i]))", "x + y"),
        {kind: F.coalesce(F.when(F.size(found) > 0, F.expr(walk)), F.expr(f"cast(array() as {SPAN})"))},
    ]


def untouched(tokens: str, base: str) -> list[dict[str, Column]]:
    """Steps of columns that end in column `tokens`: those that touch no span of base. Both are in the order of their starts.

    Parts of tokens are held against the parts of base spans that reach into them, and single ones against what is left of these.
    """
    meet = lambda x, y: f"{x}.start < {y}.end and {y}.start < {x}.end"
    near = f"flatten(transform(filter(base_p, b -> {meet('b', 'w')}), b -> filter(b.own, x -> {meet('x', 'w')})))"
    with_ends = lambda name: f"transform({parts(name)}, p -> named_struct('start', p[0].start, 'end', array_max(p.end), 'own', p))"
    free = f"flatten(transform(tokens_p, w -> element_at(transform(array({near}), n -> filter(w.own, t -> not exists(n, x -> {meet('x', 't')}))), 1)))"
    return [{"base_p": F.expr(with_ends(base)), "tokens_p": F.expr(with_ends(tokens))}, {tokens: F.when(F.size(base) == 0, F.col(tokens)).otherwise(F.expr(free))}]


def located(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key of id and text), one array of spans for each base kind, and the candidates, of every row."""
    df = text_rows(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("row"),
    )
    kept = ["doc_id", "row", "text"]
    for kind, pattern, valid, needs in [*((k, p, VALID[k], NEEDS[k]) for k, p in PATTERNS.items()), ("tokens", TOKEN, CANDIDATE, None)]:
        for step in spans(kind, pattern, valid, needs):
            df = df.withColumns(step)
        kept.append(kind)
        df = df.select(*kept)
    df = df.withColumn("base", F.array_sort(F.concat(*PATTERNS)))
    for step in untouched("tokens", "base"):
        df = df.withColumns(step)
    return df.select("doc_id", "row", *PATTERNS, "tokens")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each lower-case word occurs in all texts."""
    words = text_rows(docs).select(F.explode(F.split(F.lower("text"), SPACE)).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def patterns(found: DataFrame, words: DataFrame) -> DataFrame:
    """side, word, confidence, seeds of the lexical patterns of high confidence."""
    seeds = found.select(F.explode(F.concat(*PATTERNS)).alias("x"), F.lit(1.0).alias("seed"))
    others = found.select(F.explode("tokens").alias("x"), F.lit(0.0).alias("seed"))
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("x.before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("x.after").alias("word"))))
    slots = seeds.union(others).select(F.lower("x.m").alias("instance"), "seed", sides.alias("p")).select("instance", "seed", "p.*").filter("word <> ''")
    edges = stored(slots.groupBy("side", "word", "instance").agg(F.count(F.lit(1)).alias("times"), F.max("seed").alias("seed")), "edges")
    support = edges.filter("seed = 1").groupBy("side", "word").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS)
    support = stored(support.join(words, "word"), "patterns")
    live = stored(edges.join(support.select("side", "word"), ["side", "word"]), "edges")
    scores = live.groupBy("instance").agg(F.max("seed").alias("score"))
    for turn in range(ROUNDS):
        graph = live.join(scores, "instance").groupBy("side", "word").agg(F.sum(F.col("times") * F.col("score")).alias("mass"))
        known = support.join(graph, ["side", "word"]).withColumn("confidence", F.least(F.lit(1.0), F.col("mass") / F.col("n")))
        known = stored(known.select("side", "word", "confidence", "seeds"), "patterns")
        if turn + 1 < ROUNDS:
            scores = stored(live.join(known, ["side", "word"]).groupBy("instance").agg(F.greatest(F.max("seed"), F.max("confidence")).alias("score")), "scores")
    return known.filter(F.col("confidence") >= CONFIDENT)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, row, one array of spans for each base kind and one for `other`, of every row of docs."""
    found = stored(located(docs), "found")
    good = patterns(found, word_counts(docs))
    slots = found.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("x")).distinct()
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), F.col("x.before").alias("word")), F.struct(F.lit("after").alias("side"), F.col("x.after").alias("word"))))
    new = slots.select("row", "x", sides.alias("p")).select("row", "x", "p.*").join(good.select("side", "word"), ["side", "word"])
    new = new.groupBy("row").agg(F.array_sort(F.collect_set("x")).alias("other"))  # at most the text's own tokens
    return found.drop("tokens").join(new, "row", "left").withColumn("other", F.coalesce("other", F.expr(f"cast(array() as {SPAN})")))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    return F.array_join(F.concat(*(F.expr(f"transform({k}, x -> concat_ws(':', '{k}', string(x.start), string(x.end)))") for k in kinds)), ",")


def report(found: DataFrame) -> DataFrame:
    """The counts, digest and list of all spans for each row of `personal_data`."""
    base = list(PATTERNS)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs with each span in text replaced by its kind in angle brackets; n_chars follows, where there is one.

    Where spans touch the same characters, the one that begins first, or of these
    the longest, gives the name, and all that they cover goes.
    """
    found = personal_data(docs)
    every = F.concat(*(F.expr(f"transform({k}, x -> named_struct('start', x.start, 'back', -x.end, 'kind', '{k}'))") for k in KINDS))
    spans = found.select("row", F.array_sort(every).alias("marked")).filter(F.size("marked") > 0).dropDuplicates(["row"])
    key = F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # The row travels as one column, so that no name of it can clash.
    rows = docs.select(key.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).join(spans, "row", "left")
    rows = rows.withColumn("pieces", F.when(F.col("marked").isNotNull(), F.regexp_extract_all("doc.text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))))
    for step in running("gone", "transform(marked, x -> -x.back)", "greatest(x, y)"):  # the end of what is covered before a span
        rows = rows.withColumns(step)
    part = lambda a, b: (  # noqa: E731  characters a to b, put together from the pieces they lie in
        f"if({b} <= {a}, '', if({a} div {PIECE} = ({b} - 1) div {PIECE}, substring(pieces[int({a} div {PIECE})], {a} % {PIECE} + 1, {b} - {a}), "
        f"concat(substring(pieces[int({a} div {PIECE})], {a} % {PIECE} + 1), "
        f"array_join(slice(pieces, int({a} div {PIECE}) + 2, int(({b} - 1) div {PIECE} - {a} div {PIECE}) - 1), ''), "
        f"left(pieces[int(({b} - 1) div {PIECE})], ({b} - 1) % {PIECE} + 1))))"
    )
    end = "greatest(element_at(gone, -1), -element_at(marked, -1).back)"
    shown = f"transform(marked, (x, i) -> if(x.start < gone[i], '', concat({part('gone[i]', 'x.start')}, '<', x.kind, '>')))"
    changed = F.expr(f"array_join(concat({shown}, array({part(end, 'length(doc.text)')})), '')")
    rows = rows.withColumn("changed", F.when(F.col("marked").isNotNull(), changed))
    values = {c: F.col("doc").getField(c) for c in docs.columns}
    values["text"] = F.coalesce("changed", values["text"])
    if "n_chars" in values:
        values["n_chars"] = F.coalesce(F.length("changed").cast(docs.schema["n_chars"].dataType), values["n_chars"])
    return rows.select(*(value.alias(c) for c, value in values.items()))
