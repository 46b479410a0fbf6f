"""Rank fusion, normalisation and the statistics that compare rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import ENTRY_SEED, degrees, pagerank, rank_sql
from graphloom.plans.projections import FILE_HIST_SQL, FILES_SQL, G1_SQL, HIST_SQL, WEIGHTED_SQL, dense_edges, file_history, files, history, weighted_edges
from graphloom.plans.rounds import fractional, ordinal, placed, written
from graphloom.registry import query
from graphloom.session import table

RRF_K = 60
# Weights of the composite score's signals, those from the graph and those from history.
GRAPH_WEIGHTS = {"fan_in": 0.35, "pagerank": 0.30, "entry": 0.15}
HISTORY_WEIGHTS = {"commits": 0.10, "authors": 0.05, "recency": 0.05}
#: Signals of rank fusion, and whether more is better.
DIRECTIONS = {"fan_in": True, "pagerank": True, "commits": True, "authors": True, "days": False}
#: Priors of the categories of nodes, of the entry files above all.
ENTRY_PRIOR = 1.4


def fractional_rank(value: str, higher_is_better: bool = True, within: tuple[str, ...] = ()) -> Column:
    """Rank with ties averaged, from 1, over few rows; null of null."""
    order = W.partitionBy(*within).orderBy(F.desc_nulls_last(value) if higher_is_better else F.asc_nulls_last(value))
    peers = W.partitionBy(*within, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def minmaxed(df: DataFrame, *columns: str) -> DataFrame:
    """Columns brought to 0 to 1 between their extremes, 0.5 where these agree; one row of extremes goes to all."""
    ends = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    j = df.crossJoin(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        j = j.withColumn(c, F.when(F.col(c).isNotNull(), F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))))
    return j.select(*df.columns)


FRAC = "rank() OVER (ORDER BY {x} {d}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query("win_fractional_rank", f"WITH {HIST_SQL} SELECT id, CAST({FRAC.format(x='commits', d='DESC')} AS DOUBLE) AS r FROM hist")
def fractional_query(spark: SparkSession, sf: str) -> DataFrame:
    return fractional(history(spark, sf).select("id", "commits"), "commits", "r").select("id", F.col("r").cast("double").alias("r"))


@query("win_minmax", f"WITH {HIST_SQL} SELECT id, round((commits - min(commits) OVER ()) / (max(commits) OVER () - min(commits) OVER ()), 9) AS v FROM hist")
def minmax_query(spark: SparkSession, sf: str) -> DataFrame:
    return minmaxed(history(spark, sf), "commits").select("id", F.round("commits", 9).alias("v"))


@query("win_ordinal_rank", f"WITH {HIST_SQL} SELECT id, row_number() OVER (ORDER BY commits DESC, id) AS rank FROM hist")
def ordinal_query(spark: SparkSession, sf: str) -> DataFrame:
    return ordinal(history(spark, sf).select("id", "commits"), [F.desc("commits")], ["id"], "rank").select("id", "rank")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each file: fan_in, pagerank, entry, commits, authors, days, path."""
    e, f = written(dense_edges(spark, sf), "edges"), files(spark, sf)
    d = degrees(e, f.select("id")).select("id", "fan_in")
    p = pagerank(e, f.select("id"), tolerance=1e-12).withColumnRenamed("rank", "pagerank")
    return f.select("id", "path", F.col("is_entry").cast("double").alias("entry")).join(d, "id").join(p, "id").join(file_history(spark, sf), "id")


#: PageRank over all files; files without edges are nodes too.
ALL_FILES_RANK = rank_sql("g1", "1.0", 0.85, "true").replace("ids AS (SELECT src AS id FROM g1 UNION SELECT dst FROM g1)", "ids AS (SELECT p_partkey AS id FROM part)")
SIGNALS_SQL = f"""{G1_SQL}, {ALL_FILES_RANK}, {FILES_SQL}, {FILE_HIST_SQL}, fi AS (SELECT dst AS id, count(*) AS n FROM g1 GROUP BY 1),
sig AS (SELECT files.id, path, CAST(is_entry AS INTEGER) AS entry, coalesce(fi.n, 0) AS fan_in, prf.r AS pagerank, commits, authors, days FROM files LEFT JOIN fi USING (id) JOIN prf USING (id) JOIN fhist USING (id))"""
NORM = "CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 0.5 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"
LEGACY_SQL = f"""{SIGNALS_SQL}, nrm AS (SELECT id, path, entry, {', '.join(f"{NORM.format(x=x)} AS {x}" for x in ('fan_in', 'pagerank', 'commits', 'authors', 'days'))} FROM sig),
legacy AS (SELECT id, path, .35 * fan_in + .30 * pagerank + .15 * entry + .10 * commits + .05 * authors + .05 * coalesce(1 - days, 0) AS score FROM nrm)"""


def composite(s: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id, path, score: the weighted sum of normalised signals; a missing one adds nothing. entry is 0 or 1 as it is."""
    n = minmaxed(s, "fan_in", "pagerank", "commits", "authors", "days").withColumn("recency", 1 - F.col("days"))
    return n.select("id", "path", sum(w * F.coalesce(k, F.lit(0.0)) for k, w in weights.items()).alias("score"))


def graph_only(weights: dict[str, float] = GRAPH_WEIGHTS, missing: dict[str, float] = HISTORY_WEIGHTS) -> dict[str, float]:
    """Weights where there is no history: the graph's share in what is missing too."""
    scale = 1 + sum(missing.values()) / sum(weights.values())
    return {k: w * scale for k, w in weights.items()}


@query("gr_legacy_score", f"WITH RECURSIVE {LEGACY_SQL} SELECT id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (ORDER BY round(CAST(score AS DOUBLE), 12) DESC, path) AS rank FROM legacy")
def legacy_query(spark: SparkSession, sf: str) -> DataFrame:
    """Six signals; ranks 1 to n by score and path. Scores that differ by rounding errors alone are equal."""
    c = composite(signals(spark, sf), GRAPH_WEIGHTS | HISTORY_WEIGHTS).withColumn("s", F.round("score", 12))
    return ordinal(c, [F.desc("s")], ["path"], "rank").select("id", F.round("score", 6).alias("score"), "rank")


RRF_SQL = f"""{SIGNALS_SQL}, rrf AS (SELECT id, path, {' + '.join(f"1.0 / (60 + {FRAC.format(x=x, d='DESC' if up else 'ASC NULLS LAST')})" if x != 'days' else f"CASE WHEN days IS NULL THEN 0 ELSE 1.0 / (60 + {FRAC.format(x=x, d='ASC NULLS LAST')}) END" for x, up in DIRECTIONS.items())} AS score FROM (SELECT id, path, fan_in, round(pagerank, 12) AS pagerank, commits, authors, days FROM sig))"""


def fused(s: DataFrame, directions: dict[str, bool] = DIRECTIONS, k: int = RRF_K) -> DataFrame:
    """id, score: the sum of 1 / (k + rank) over the signals, ties averaged; a missing value contributes nothing.

    Signals are ranked as one long table, dealt by ranges of (signal, value).
    """
    pairs = F.array(*(F.struct(F.lit(x).alias("signal"), (F.col(x).cast("double") * (-1 if up else 1)).alias("key")) for x, up in directions.items()))
    long = s.select("id", F.inline(pairs)).filter("key is not null")
    r = fractional(long, "key", "rank", False, ("signal",))
    return r.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


@query("gr_rrf", f"WITH RECURSIVE {RRF_SQL} SELECT id, round(CAST(score AS DOUBLE), 9) AS score, row_number() OVER (ORDER BY round(CAST(score AS DOUBLE), 12) DESC, path) AS rank FROM rrf")
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of five signals, each in its own direction."""
    s = written(signals(spark, sf).withColumn("pagerank", F.round("pagerank", 12)), "signals")
    c = fused(s).join(s.select("id", "path"), "id").withColumn("s", F.round("score", 12))
    return ordinal(c, [F.desc("s")], ["path"], "rank").select("id", F.round("score", 9).alias("score"), "rank")


CATEGORY_SQL = "CASE WHEN contains(path, '.config.') THEN 'config' WHEN contains(path, 'alembic/versions/') THEN 'migration' WHEN ends_with(path, '_pb2.py') THEN 'generated' WHEN ends_with(path, '/__init__.py') THEN 'barrel' ELSE 'source' END"
PRIOR_SQL = "CASE WHEN entry THEN 1.4 WHEN category = 'config' THEN .2 WHEN category = 'migration' THEN .15 WHEN category = 'generated' THEN .05 WHEN category = 'barrel' THEN .4 ELSE 1 END"
WPR_SQL = f"""{WEIGHTED_SQL}, {rank_sql('wg', 'weight', 0.65, ENTRY_SEED)}, {FILES_SQL}, pr2 AS (SELECT prf.id, prf.r, path, is_entry AS entry, {CATEGORY_SQL} AS category FROM prf JOIN files USING (id)),
sc AS (SELECT id, path, category, r, round(CAST(r * {PRIOR_SQL} AS DOUBLE), 12) AS s FROM pr2)"""


def prior_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """id, path, category, pagerank, score: weighted personalised PageRank times the prior of the file's category.

    Seeds are the entry files that lead on to others; without any there is no ranking, and an error says so.
    """
    from graphloom.operators.rules import PRIORS, node_category

    e, f = weighted_edges(spark, sf), files(spark, sf)
    seeds = f.filter("is_entry").select("id").join(e.select(F.col("src").alias("id")), "id", "left_semi")
    if seeds.isEmpty():
        raise ValueError("no entry file leads to another: nothing to start from")
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    p = pagerank(e, nodes, 0.65, tolerance=1e-12, seeds=seeds)
    known = F.create_map(*(F.lit(x) for kv in PRIORS.items() for x in kv))
    j = p.join(f, "id").withColumn("category", node_category(F.col("path")))
    prior = F.when(F.col("is_entry"), ENTRY_PRIOR).otherwise(known[F.col("category")])
    return j.select("id", "path", "category", F.col("rank").alias("pagerank"), F.round(F.col("rank") * prior, 12).alias("score"))


@query("gr_prior_score", f"WITH RECURSIVE {WPR_SQL} SELECT id, category, round(s, 8) AS score, row_number() OVER (ORDER BY s DESC, path) AS rank, round((SELECT avg(CASE WHEN r = 0 THEN 100.0 ELSE 0 END) FROM sc), 4) AS zero_mass_percent FROM sc")
def prior_query(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by score and path, and the share of files that the seeds' mass never reaches."""
    s = written(prior_ranked(spark, sf), "scores")
    zero = s.agg(F.round(F.avg(F.when(F.col("pagerank") == 0, 100.0).otherwise(0.0)), 4).alias("zero_mass_percent"))
    r = ordinal(s, [F.desc("score")], ["path"], "rank")
    return r.crossJoin(F.broadcast(zero)).select("id", "category", F.round("score", 8).alias("score"), "rank", "zero_mass_percent")


@query("st_ablation", f"""WITH RECURSIVE {SIGNALS_SQL}, nrm AS (SELECT id, path, entry, {', '.join(f"{NORM.format(x=x)} AS {x}" for x in ('fan_in', 'pagerank', 'commits', 'authors', 'days'))} FROM sig),
w(signal, wf, wp, we, wc, wa, wr) AS (VALUES ('', .35, .30, .15, .10, .05, .05), ('fan_in', 0, .30, .15, .10, .05, .05), ('pagerank', .35, 0, .15, .10, .05, .05), ('entry', .35, .30, 0, .10, .05, .05), ('commits', .35, .30, .15, 0, .05, .05), ('authors', .35, .30, .15, .10, 0, .05), ('recency', .35, .30, .15, .10, .05, 0)),
sc AS (SELECT signal, id, row_number() OVER (PARTITION BY signal ORDER BY round(CAST(wf * fan_in + wp * pagerank + we * entry + wc * commits + wa * authors + wr * coalesce(1 - days, 0) AS DOUBLE), 9) DESC, path) AS rank FROM nrm, w),
t AS (SELECT * FROM sc WHERE rank <= 20), j AS (SELECT b.signal, row_number() OVER (PARTITION BY b.signal ORDER BY a.rank) AS ra, row_number() OVER (PARTITION BY b.signal ORDER BY b.rank) AS rb FROM t a JOIN t b ON a.id = b.id WHERE a.signal = '' AND b.signal <> '')
SELECT signal, 20 - count(*) AS n_left, round(1 - 6.0 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 9) AS rho FROM j GROUP BY signal""")
def ablation(spark: SparkSession, sf: str, n: int = 20) -> DataFrame:
    """Each signal left out in turn: how many files leave the top n (as many enter), and Spearman's rho of those that stay.

    Top lists have n rows each; only these are compared. Of a single file that stays rho is NaN.
    """
    s = written(minmaxed(signals(spark, sf), "fan_in", "pagerank", "commits", "authors", "days").withColumn("recency", 1 - F.col("days")), "signals")
    weights = GRAPH_WEIGHTS | HISTORY_WEIGHTS

    def top(left_out: str) -> DataFrame:
        score = F.round(sum(w * F.coalesce(k, F.lit(0.0)) for k, w in weights.items() if k != left_out), 9)
        t = s.select("id", "path", score.alias("s")).orderBy(F.desc("s"), "path").limit(n)
        return t.select(F.lit(left_out).alias("signal"), "id", F.row_number().over(W.orderBy(F.desc("s"), "path")).alias("rank"))

    base = top("").select("id", F.col("rank").alias("base"))
    rows = top(next(iter(weights)))
    for k in list(weights)[1:]:
        rows = rows.unionByName(top(k))
    own = W.partitionBy("signal")
    j = rows.join(F.broadcast(base), "id").select("signal", F.row_number().over(own.orderBy("base")).alias("ra"), F.row_number().over(own.orderBy("rank")).alias("rb"))
    m = F.count(F.lit(1))
    return j.groupBy("signal").agg((n - m).alias("n_left"), F.round(1 - 6 * F.sum((F.col("ra") - F.col("rb")) ** 2) / F.when(m > 1, m * (m * m - 1)).otherwise(float("nan")), 9).alias("rho"))


@query("st_pearson", f"WITH {HIST_SQL} SELECT round(corr(commits, authors), 9) AS r FROM hist")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).agg(F.round(F.corr(F.col("commits").cast("double"), F.col("authors").cast("double")), 9).alias("r"))


TOP_SQL = "top AS (SELECT c_custkey AS id, c_acctbal AS x, c_custkey % 37 AS y FROM customer)"


@query("st_spearman_top", f"""WITH {TOP_SQL}, a AS (SELECT id, x FROM top ORDER BY x DESC, id LIMIT 800), b AS (SELECT id, y FROM top ORDER BY y DESC, id LIMIT 800), j AS (SELECT id, x, y FROM a JOIN b USING (id)),
r AS (SELECT rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y DESC) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j) SELECT count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r""")
def spearman_top(spark: SparkSession, sf: str, n: int = 800) -> DataFrame:
    """Correlation of ranks within the intersection of two top-n lists: NaN where either side's are all tied, null without rows."""
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 37).alias("y"))
    j = t.select("id", "x").orderBy(F.desc("x"), "id").limit(n).join(t.select("id", "y").orderBy(F.desc("y"), "id").limit(n), "id")
    r = j.select(fractional_rank("x").alias("rx"), fractional_rank("y").alias("ry"))
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.when(spread == 0, float("nan")).otherwise(F.covar_pop("rx", "ry") / F.nullif(spread, F.lit(0.0))), 9).alias("rho"))


@query("st_overlap_at", f"WITH {TOP_SQL}, a AS (SELECT id FROM top ORDER BY x DESC, id LIMIT 400), b AS (SELECT id FROM top ORDER BY y DESC, id LIMIT 400) SELECT count(*) AS overlap, count(*) >= 12 AS go FROM a JOIN b USING (id)")
def overlap_at(spark: SparkSession, sf: str, n: int = 400) -> DataFrame:
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 37).alias("y"))
    both = t.orderBy(F.desc("x"), "id").limit(n).select("id").join(t.orderBy(F.desc("y"), "id").limit(n).select("id"), "id")
    return both.agg(F.count(F.lit(1)).alias("overlap"), (F.count(F.lit(1)) >= 12).alias("go"))


def rising(order: np.ndarray) -> int:
    """Pairs i < j with order[i] < order[j], by the bits of the values from the highest down."""
    values = np.unique(order, return_inverse=True)[1].astype(np.int64)
    total, n = 0, len(values)
    for bit in reversed(range(max(int(values.max()).bit_length(), 1) if n else 0)):
        by = np.argsort(values >> (bit + 1), kind="stable")
        prefix, one = values[by] >> (bit + 1), values[by] >> bit & 1
        zeros = np.cumsum(1 - one)
        first = np.searchsorted(prefix, prefix)
        total += int(((zeros - np.where(first > 0, zeros[first - 1], 0)) * one).sum())
    return total


def balance(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs that rise together less pairs that don't; ties in either count for neither."""
    up, down = np.lexsort((-y, x)), np.lexsort((y, x))
    return rising(y[up]) - rising(-y[down])


def kendall_tau(pairs: DataFrame) -> DataFrame:
    """tau-b of columns x and y; null for fewer than two rows or a constant column. Nulls are left out.

    Rows are dealt into ranges of x and ranges of y. Rows in different ranges of both are compared by counts of the
    ranges' cells, rows in one range of x or of y within that range: no task holds more than a range, none a pair.
    """
    p = pairs.filter("x is not null and y is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    a = placed(p, [F.asc("x")]).select("x", "y", F.col("bucket").alias("bx"))
    c = written(placed(a, [F.asc("y")]).select("x", "y", "bx", F.col("bucket").alias("by")), "cells")
    inside = c.groupBy("bx").applyInPandas(lambda d: pd.DataFrame({"s": [balance(d["x"].to_numpy(), d["y"].to_numpy())]}), "s long")
    across = c.groupBy("by").applyInPandas(lambda d: pd.DataFrame({"s": [balance(d["bx"].to_numpy().astype(float), d["y"].to_numpy())]}), "s long")
    cells = c.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select("bx").distinct().crossJoin(F.broadcast(cells.select("by").distinct())).join(cells, ["bx", "by"], "left").fillna(0, ["n"])  # a row for each two ranges
    row = W.partitionBy("bx").orderBy("by")
    grid = grid.withColumn("less", F.coalesce(F.sum("n").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("more", F.coalesce(F.sum("n").over(row.rowsBetween(1, W.unboundedFollowing)), F.lit(0)))
    before = W.partitionBy("by").orderBy("bx").rowsBetween(W.unboundedPreceding, -1)
    between = grid.select((F.col("n") * (F.coalesce(F.sum("less").over(before), F.lit(0)) - F.coalesce(F.sum("more").over(before), F.lit(0)))).alias("s"))
    total = inside.unionByName(across).unionByName(between).agg(F.sum("s").alias("s"))

    def ties(k: str) -> DataFrame:
        n = c.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t{k}"))

    n = c.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("all"))
    j = total.crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(n)  # one row each
    return j.select(F.try_divide(F.col("s").cast("double"), F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))).alias("tau"))


@query("st_kendall", """WITH a AS (SELECT c_custkey AS i, c_acctbal AS x, c_custkey % 37 AS y FROM customer), p AS (SELECT sign(b.x - a.x) AS dx, sign(b.y - a.y) AS dy FROM a JOIN a b ON a.i < b.i)
SELECT round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 9) AS tau FROM p""")
def kendall(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 37).alias("y"))
    return kendall_tau(c).select(F.round("tau", 9).alias("tau"))


@query("st_severity", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0.0 WHEN p_size >= 40 THEN 1.0 ELSE round((p_size - 10) / 30.0, 9) END AS severity FROM part")
def severity(spark: SparkSession, sf: str, warn: float = 10, saturate: float = 40) -> DataFrame:
    """Linear from warn to saturate; a step where they don't differ."""
    v = F.col("p_size")
    ramp = F.when(v <= warn, 0.0).when(v >= saturate, 1.0).otherwise(F.round((v - warn) / (saturate - warn), 9)) if saturate > warn else F.when(v > warn, 1.0).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", ramp.cast("double").alias("severity"))


@query("hs_exposure", "SELECT p_partkey, round(p_retailprice / (greatest(p_size * 20, 30) / 100.0), 6) AS exposure FROM part")
def exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Points by unit of review cost."""
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") / (F.greatest(F.col("p_size") * 20, F.lit(30)) / 100), 6).alias("exposure"))


@query("srt_nulls_last", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey) AS pos FROM customer")
def nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return ordinal(table(spark, sf, "customer").select("c_custkey", v.alias("v")), [F.desc_nulls_last("v")], ["c_custkey"], "pos").select("c_custkey", "pos")


@query("srt_truthful_limit", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS total, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) > 25 AS truncated FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def truthful_limit(spark: SparkSession, sf: str, cap: int = 25) -> DataFrame:
    """A capped list with the number that it is of."""
    o = table(spark, sf, "orders").filter("o_totalprice > 300000")
    n = o.agg(F.count(F.lit(1)).alias("total"))
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(cap).select("o_orderkey").crossJoin(F.broadcast(n)).withColumn("truncated", F.col("total") > cap)


@query("srt_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)
