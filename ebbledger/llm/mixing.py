"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of tokens (words) to an exponent between 0 (all
alike) and 1 (as they are), normalised. The exponent is the largest that meets the
target entropy, or, where that would repeat some source too often, the smallest
that keeps to the repetition limit. It is bisected on a grid: one aggregation of
the source table gives 63 points, that is six halvings.

The budget is the smallest at which every source is passed through at least once,
or what the caller names. A source gets whole passes, and a part of one more:
documents fall into blocks by a hash, blocks follow each other by number and the
documents in a block by the hash. The part takes blocks from the first one on, and
from the block that the budget ends in the documents up to where it ends. Blocks
are of bounded size, so a running sum is needed inside one block for each source
only; a source with most of all documents is never sorted as a whole.

All of it is Spark SQL expressions. A null source is a source of its own. Null and
empty texts have no words: they come with every pass of their source, and a source
without any word gets one pass. Where whole passes use the budget up there is no part. Documents without an id share a place in the order.
Repeated rows count each, and come or stay away together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbledger.llm.common import SPACE, stored

#: Target entropy as a part of the largest possible, most passes through a source, documents in a block, name of the order.
ENTROPY, REPETITIONS, BLOCK_DOCS, SEED = 0.9, 4.0, 2_000, "mix"
#: Blocks of a source whose running sums are one task's; their groups are the next level.
GROUP_BLOCKS = 1_024
#: Rounds of the search, and halvings in each.
ROUNDS, HALVINGS = 5, 6


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary"))


def block_of(key: Column, blocks: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % blocks


def exponent(sources: DataFrame, entropy: float, repetitions: float) -> float:
    """The exponent for the sources' tokens; two bisections in step, on shares as measured."""
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    shares = sources.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    most = 2**HALVINGS
    flat_enough, few_enough = 0.0, 0.0  # the first: the largest known to meet the entropy; the second: the largest known not to keep the limit
    step = 1.0
    for _ in range(ROUNDS):
        step /= most
        grid = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(low + i * step).alias("a")) for kind, low in (("entropy", flat_enough), ("limit", few_enough)) for i in range(1, most + 1)))).alias("x")
        z = F.sum(F.pow("p", F.col("x.a")))
        rows = (
            shares.select("p", grid)
            .groupBy("x.kind", "x.a")
            .agg(
                (F.log(z) - F.col("x.a") * F.sum(F.pow("p", F.col("x.a")) * F.log("p")) / z).alias("h"),
                F.pow(F.max("p") / F.min("p"), 1 - F.col("x.a")).alias("passes"),
                F.log(F.count(F.lit(1))).alias("top"),
            )
            .collect()
        )
        flat_enough = max([flat_enough, *(r["a"] for r in rows if r["kind"] == "entropy" and r["h"] >= entropy * r["top"])])
        few_enough = max([few_enough, *(r["a"] for r in rows if r["kind"] == "limit" and r["passes"] > repetitions)])
    return max(flat_enough, few_enough)


def planned(docs: DataFrame, entropy: float = ENTROPY, repetitions: float = REPETITIONS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """source, tokens, weight, budget, passes, blocks, and the block and key that the last, partial pass ends at."""
    rows = stored(docs.select("source", n_words(F.col("text")).alias("n"), order_key(F.col("doc_id"), seed).alias("key")), "counted")
    sources = stored(rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("blocks")), "sources")
    a = exponent(sources, entropy, repetitions)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighed = sources.withColumn("weight", power / z)
    least = weighed.agg(F.max(F.try_divide("tokens", "weight"))).first()[0] or 0.0
    whole = float(budget) if budget is not None else least
    weighed = weighed.withColumn("budget", F.round(F.col("weight") * whole).cast("long"))
    weighed = weighed.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long"))
    weighed = stored(weighed.withColumn("rest", F.greatest(F.lit(0), F.col("budget") - F.col("passes") * F.col("tokens"))).select("source", "tokens", "blocks", "weight", "budget", "passes", "rest"), "weighed")
    s = weighed.select(F.col("source").alias("s"), "blocks", "rest")
    placed = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block_of(F.col("key"), F.col("blocks"))).drop("s", "blocks")
    sums = placed.groupBy("source", "block").agg(F.sum("n").alias("in_block"), F.first("rest").alias("rest"))
    through = running(sums)
    # the first block that does not fit as a whole; past the last block where all do
    ends = stored(through.filter(F.col("through") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("block", (F.col("through") - F.col("in_block")).alias("before")), "block").alias("x")).select("source", "x.*"), "ends")
    e = ends.select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    inside = placed.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", upto).filter(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max("key").alias("last_key"))
    out = weighed.join(ends.select(F.col("source").alias("s1"), F.col("block").alias("last_block")), F.col("source").eqNullSafe(F.col("s1")), "left")
    out = out.join(last.select(F.col("source").alias("s2"), "last_key"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.select("source", "tokens", "weight", "budget", "passes", "blocks", F.when(F.col("rest") > 0, F.coalesce("last_block", "blocks")).otherwise(-1).alias("last_block"), F.coalesce("last_key", F.lit("")).alias("last_key"))


def running(sums: DataFrame) -> DataFrame:
    """sums (source, block, in_block, ..) with `through`, the sum up to each block, in two levels: a source with very many blocks is not one task."""
    grouped = sums.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    inside = Window.partitionBy("source", "group").orderBy("block")
    before = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy(F.col("source").alias("s"), F.col("group").alias("g")).agg(F.sum("in_block").alias("whole"))
    groups = groups.select("s", "g", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("earlier"))
    joined = grouped.withColumn("through", F.sum("in_block").over(inside)).join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
    return joined.select(*sums.columns, (F.col("through") + F.col("earlier")).alias("through"))


def mixed(docs: DataFrame, plan: DataFrame, seed: str = SEED, numbered: bool = True) -> DataFrame:
    """The rows of docs as often as the plan says; numbered, with `_epoch` (from 1) and `_block`. Any columns of docs stay as they are."""
    taken = {"_epoch", "_block"} & set(docs.columns)
    if numbered and taken:
        raise ValueError(f"docs has columns {sorted(taken)} of its own")
    p = plan.select(F.struct("source", "passes", "blocks", "last_block", "last_key").alias("plan"))
    # The row travels as one column, so that no name of it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), order_key(docs["doc_id"], seed).alias("key"))
    df = rows.join(p, F.col("doc.source").eqNullSafe(F.col("plan.source"))).withColumn("_block", block_of(F.col("key"), F.col("plan.blocks")))
    more = (F.col("_block") < F.col("plan.last_block")) | ((F.col("_block") == F.col("plan.last_block")) & (F.col("key") <= F.col("plan.last_key")))
    times = F.col("plan.passes") + more.cast("long")
    df = df.filter(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return df.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], *(["_epoch", "_block"] if numbered else []))


def oracle_sql(entropy: float = ENTROPY, repetitions: float = REPETITIONS, seed: str = SEED) -> str:
    """DuckDB's statement of op7: words by regular expression, the search as one table for each round."""
    most = 2**HALVINGS
    rounds, before = [], "(SELECT 0.0::DOUBLE AS e, 0.0::DOUBLE AS l)"
    for k in range(1, ROUNDS + 1):
        step = repr(float(most) ** -k)
        rounds.append(
            f"""t{k} AS (SELECT greatest(any_value(e0), coalesce(max(CASE WHEN kind = 0 AND h >= {entropy} * top THEN a END), 0)) AS e,
       greatest(any_value(l0), coalesce(max(CASE WHEN kind = 1 AND passes > {repetitions} THEN a END), 0)) AS l
  FROM (SELECT kind, a, any_value(e) AS e0, any_value(l) AS l0, ln(sum(pow(p, a))) - a * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) AS h,
               pow(max(p) / min(p), 1 - a) AS passes, ln(count(*)) AS top
          FROM (SELECT p, kind, e, l, CASE kind WHEN 0 THEN e ELSE l END + i * {step} AS a
                  FROM shares, {before} AS b, (SELECT unnest([0, 1]) AS kind), (SELECT unnest(range(1, {most + 1})) AS i)) GROUP BY kind, a))"""
        )
        before = f"t{k}"
    return f"""WITH words AS (
  SELECT doc_id, source, md5(concat_ws(':', '{seed}', doc_id)) AS k, n_w AS n
    FROM (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_w FROM documents)),
sources AS (SELECT source, sum(n)::BIGINT AS tokens, ceil(count(*) / {BLOCK_DOCS}.0)::BIGINT AS blocks FROM words GROUP BY source),
shares AS (SELECT tokens::DOUBLE / (SELECT sum(tokens) FROM sources)::DOUBLE AS p FROM sources WHERE tokens > 0),
{", ".join(rounds)},
powers AS (SELECT *, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE / (SELECT sum(tokens) FROM sources)::DOUBLE, (SELECT greatest(e, l) FROM t{ROUNDS})) ELSE 0 END AS power FROM sources),
weights AS (SELECT *, power / (SELECT sum(power) FROM powers) AS weight FROM powers),
budgets AS (SELECT *, CASE WHEN tokens > 0 THEN round(weight * (SELECT max(tokens / weight) FROM weights WHERE tokens > 0))::BIGINT ELSE 0 END AS budget FROM weights),
passes AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS full_passes FROM budgets),
placed AS (SELECT w.*, full_passes, greatest(0, budget - full_passes * tokens) AS rest, ('0x' || substr(k, 1, 8))::BIGINT % blocks AS block
             FROM words w JOIN passes p ON w.source IS NOT DISTINCT FROM p.source),
run AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY block, k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
times AS (SELECT doc_id, source, n, block, full_passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM run)
SELECT doc_id, source, unnest(range(1, times + 1))::BIGINT AS epoch, block::BIGINT AS block FROM times WHERE times > 0"""
