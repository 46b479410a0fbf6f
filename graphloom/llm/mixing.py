"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by exact length.

A source is read whole as often as its target allows; the rest of its budget is fitted by length: every length gives
its share of documents, rounded down over all lengths, and a bounded knapsack over the counts left fits what then
remains; where that misses the budget, the knapsack takes more, up to the whole budget. Where one more copy of each
document can't meet the rest, the knapsack has all copies that ``repeats`` allows, and then fewer whole passes below
them. Copies of a length are dealt evenly over its documents; which get one more is decided by a seeded hash.

A null text has size 0 and is taken 0 times for its words. A null source is a source of its own, last in order. Rows
are interchangeable if id, source and text agree; each gets its own share. A very long text is one value in one row;
its words are counted where it is read, and no text is shuffled. Other columns are ignored by the plan; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, rank_in_groups, rows_of, running_sums, same, whole_text, words_of
from graphloom.llm.packing import fullest

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 20240117
KNAPSACK = 1 << 16  # the knapsack's share of the budget at first is half of this, and what rounding leaves


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> with target: shares of the total by weight, none above ``repeats`` times its size.

    In order of size by weight the capped sources come first; at each place, what is left by weight left is the level
    that the rest would get, and the highest such level is where resharing ends.
    """
    s = running_sums(sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"n": F.col("one")}, "by-name")
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("n", F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).select("source", "source_size", "weight", "cap")
    s = running_sums(s, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, "by-cap")
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = s.agg(F.max((F.lit(whole.size) - F.col("cap_before")) / (F.lit(whole.weight) - F.col("weight_before")))).first()[0]
    return s.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.lit(level or 0.0)).alias("target"))


def completed(base: dict[int, int], counts: dict[int, int], budget: int) -> dict[int, int]:
    """The best way to fill the budget that takes at least ``base``; lengths come largest first."""
    take, left = dict(base), budget - sum(x * n for x, n in base.items())
    spare = {x: n - base[x] for x, n in counts.items()}
    for x in fullest([x for x in counts if x <= left and spare[x]], spare, left):
        take[x] += 1
    return take


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes as near to the budget, from below, as it can.

    The rounded shares are a first part, and the knapsack fits the rest. Where it misses the budget, its part grows
    until it meets it or is exact. It is exact over the whole budget, or if it may undo ``change`` documents of each
    length: ordered so that its running sum stays within the longest length, a larger change from one fit to a better
    one has a stretch that adds up to 0 and can be left out.
    """
    counts = {x: counts[x] for x in sorted(counts, reverse=True) if x > 0 and counts[x] > 0}
    if not counts:
        return {}
    unit = math.gcd(*counts)
    counts = {x // unit: n for x, n in counts.items()}
    total, longest = sum(x * n for x, n in counts.items()), max(counts)
    budget, room = max(0, min(budget // unit, total)), KNAPSACK
    while True:
        share, before, base = max(0, budget - room // 2), 0, {}
        for x, n in counts.items():  # rounded down over all longer lengths, so that single documents have their share too
            base[x] = (before + n) * share // total - before * share // total
            before += n
        take = completed(base, counts, budget)
        missing = budget - sum(x * n for x, n in take.items())
        if not missing or not share:
            break
        room *= 8
        change = longest + max(longest, missing)
        base = {x: max(0, n - change) for x, n in take.items()}
        if budget - sum(x * n for x, n in base.items()) <= room:
            take = completed(base, counts, budget)
            break
    return {x * unit: n for x, n in take.items()}


def copies(counts: dict[int, int], target: float, repeats: int = MOST_REPEATS) -> dict[int, int]:
    """How many copies of documents of each length to take, up to ``repeats`` of each, to come near the target.

    Whole passes over the source stay below what is fitted, as many as leave the budget a way to be met: first with one
    more copy of each document at most, then with all that are allowed, then with a pass less.
    """
    counts = {x: n for x, n in counts.items() if x > 0 and n > 0}
    size, budget = sum(x * n for x, n in counts.items()), round(target)
    if not size:
        return {}
    passes = min(repeats, budget // size)
    best: tuple[int, dict[int, int]] | None = None
    for whole, most in dict.fromkeys([(passes, min(1, repeats - passes)), *((p, repeats - p) for p in range(passes, -1, -1))]):
        rest = budget - whole * size
        more = fit({x: n * most for x, n in counts.items()}, rest)
        missing = rest - sum(x * n for x, n in more.items())
        if best is None or missing < best[0]:
            best = missing, {x: whole * n + more.get(x, 0) for x, n in counts.items()}
        if not missing:
            break
    return best[1]


def _fit_source(rows: pd.DataFrame, repeats: int) -> pd.DataFrame:
    counts = dict(zip(rows["size"].tolist(), rows["n"].tolist(), strict=True))
    take = copies(counts, float(rows["target"].iloc[0]), repeats)
    size, n = rows["size"].tolist(), rows["n"].tolist()
    taken = [take.get(x, 0) for x in size]
    return pd.DataFrame({"source": rows["source"], "size": size, "times": [t // k for t, k in zip(taken, n, strict=True)], "more": [t % k for t, k in zip(taken, n, strict=True)]})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, times: how often each document goes into the mix.

    The knapsack sees counts by source and length only; a source or length with a third of all documents is ranked
    over buckets.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.size(words_of(whole_text())).cast("long").alias("size"))
    sized = materialize(sized, "sizes")
    by_length = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = materialize(targets(sources, weights, repeats), "targets")
    known = by_length.alias("a").join(wanted.alias("b"), same("a", "b", ["source"])).select("a.*", "b.source_size", "b.target")
    plan = known.groupBy("source").applyInPandas(lambda rows: _fit_source(rows, repeats), "source string, size long, times long, more long")
    plan = materialize(plan, "plan")
    hashed = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    ranked = rank_in_groups(hashed, ["source", "size"], "h", ["doc_id", "text_hash"], "rank").drop("h")
    told = ranked.alias("a").join(plan.alias("b"), same("a", "b", ["source", "size"])).select("a.*", (F.col("times") + (F.col("rank") < F.col("more")).cast("long")).alias("times")).drop("rank")
    return told.alias("a").join(wanted.alias("b"), same("a", "b", ["source"])).select("a.*", "b.source_size", "b.target")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it."""
    keys = ["doc_id", "source", "text_hash"]
    m = materialize(mix(docs, weights, repeats, seed).filter("times > 0").select(*keys, "times"), "mix")
    left = rows_of(docs, doc_id="doc_id", source="source", text_hash=F.xxhash64("text"))
    on = keys
    if not m.groupBy(*keys).count().filter("count > 1").isEmpty():  # rows that agree in all keys: number both sides alike
        left = left.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1))))
        m = m.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("times"))))
        on = [*keys, "k"]
    j = left.alias("a").join(m.alias("b"), same("a", "b", on)).select("a.row", "b.times")
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")
