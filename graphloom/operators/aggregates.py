"""Aggregations with explicit not-available semantics: roll-ups over path hierarchies, percentiles, shares, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.projections import HIST_SQL, PATH_SQL, history, paths
from graphloom.registry import query
from graphloom.session import table


def ancestors(path: Column) -> Column:
    """Every directory above a path, and the root sentinel."""
    parts = F.split(path, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("(root)")), own)).otherwise(F.array(F.lit("(root)")))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """Keys with p<percent>: the value at round-half-even(p/100 * (n-1)) in order, by counts of equal values, so that no list is gathered."""
    own = W.partitionBy(*keys)
    n = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    n = n.withColumn("__upto", F.sum("__n").over(own.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(own))
    place = lambda p: F.bround(F.lit(p) / 100 * (F.col("__all") - 1))
    return n.groupBy(*keys).agg(*(F.min(F.when(F.col("__upto") > place(p), F.col(value))).alias(f"p{p}") for p in percents))


def directory_rollup(rows: DataFrame) -> DataFrame:
    """dir, files, measured, weighted_mean, worst: each file counts in every directory above it; unmeasured values are left out, not zeroed."""
    e = rows.withColumn("dir", F.explode(ancestors(F.col("path"))))
    seen = F.col("value").isNotNull()
    weights = F.sum(F.when(seen, F.col("weight")))
    mean = F.when(weights > 0, F.sum(F.col("value") * F.col("weight")) / weights).otherwise(F.avg("value"))
    return e.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.count("value").alias("measured"), F.round(mean, 6).alias("weighted_mean"), F.min("value").alias("worst"), (F.count("value") >= 3).alias("rankable"))


ROLLUP_SQL = f"""WITH {PATH_SQL}, {HIST_SQL}, f AS (SELECT path, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE value END AS value, coalesce(commits, 0) AS weight FROM paths LEFT JOIN hist ON id = c_custkey),
e AS (SELECT unnest(['(root)', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) AS dir, value, weight FROM f),
roll AS (SELECT dir, count(*) AS files, count(value) AS measured, round(CASE WHEN sum(CASE WHEN value IS NOT NULL THEN weight END) > 0 THEN sum(value * weight) / sum(CASE WHEN value IS NOT NULL THEN weight END) ELSE avg(value) END, 6) AS weighted_mean, min(value) AS worst, count(value) >= 3 AS rankable FROM e GROUP BY dir)"""


def measured_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = paths(spark, sf).join(history(spark, sf).withColumnRenamed("id", "c_custkey"), "c_custkey", "left")
    return p.select("path", F.when(F.col("c_custkey") % 11 != 0, F.col("value")).alias("value"), F.coalesce("commits", F.lit(0)).alias("weight"))


@query("agg_directory_rollup", f"{ROLLUP_SQL} SELECT * FROM roll")
def rollup_query(spark: SparkSession, sf: str) -> DataFrame:
    return directory_rollup(measured_paths(spark, sf))


@query("agg_weakest_directories", f"{ROLLUP_SQL} SELECT dir, weighted_mean FROM roll WHERE rankable ORDER BY weighted_mean, dir LIMIT 5")
def weakest_directories(spark: SparkSession, sf: str) -> DataFrame:
    return directory_rollup(measured_paths(spark, sf)).filter("rankable").orderBy("weighted_mean", "dir").limit(5).select("dir", "weighted_mean")


@query("agg_overview_counts", "SELECT count(*) AS files, CAST(sum(p_size) AS BIGINT) AS total_size, count(DISTINCT p_brand) AS groups, count(*) FILTER (p_size >= 40) AS large, (SELECT count(*) FROM lineitem) AS edges FROM part")
def overview_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("files"), F.sum("p_size").alias("total_size"), F.countDistinct("p_brand").alias("groups"), F.count_if(F.col("p_size") >= 40).alias("large"))
    return a.crossJoin(table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query("agg_group_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("agg_next_index", "SELECT o_custkey, coalesce(max(o_orderkey), -1) + 1 AS next_index FROM orders GROUP BY o_custkey")
def next_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(-1)) + 1).alias("next_index"))


@query("agg_degenerate", f"WITH {HIST_SQL} SELECT count(DISTINCT commits) <= 1 AS degenerate, count(DISTINCT commits) AS n_distinct FROM hist")
def degenerate(spark: SparkSession, sf: str) -> DataFrame:
    n = F.countDistinct("commits")
    return history(spark, sf).agg((n <= 1).alias("degenerate"), n.alias("n_distinct"))


@query("agg_resolution_rate", "SELECT round(avg(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 1.0 ELSE 0 END), 9) AS rate FROM orders")
def resolution_rate(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1.0).alias("hit"))
    return table(spark, sf, "orders").join(good, "o_custkey", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("rate"))


RANK_SQL = "list_sort(list({x}))[CAST(round_even({p} / 100.0 * (count({x}) - 1), 0) AS INTEGER) + 1]"


@query("agg_repo_context", f"WITH {HIST_SQL} SELECT count(DISTINCT commits) >= 3 AS churn_usable, " + ", ".join(f"{RANK_SQL.format(x='commits', p=p)} AS p{p}" for p in (50, 90, 95, 99)) + " FROM hist")
def repo_context(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    return h.agg((F.countDistinct("commits") >= 3).alias("churn_usable")).crossJoin(nearest_ranks(h, [], "commits", (50, 90, 95, 99)))  # one row each


@query("agg_axis_summary", "SELECT c_mktsegment AS axis, count(*) FILTER (c_acctbal >= 0) AS n, count(*) FILTER (c_acctbal < 0) AS not_available, round(avg(c_acctbal) FILTER (c_acctbal >= 0), 6) AS mean, " + ", ".join(f"list_sort(list(c_acctbal) FILTER (c_acctbal >= 0))[CAST(round_even({p} / 100.0 * (count(*) FILTER (c_acctbal >= 0) - 1), 0) AS INTEGER) + 1] AS p{p}" for p in (10, 50, 90)) + " FROM customer GROUP BY 1")
def axis_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    a = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("axis")).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("not_available"), F.round(F.avg(v), 6).alias("mean"))
    ranks = nearest_ranks(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("axis"), v.alias("v")), ["axis"], "v", (10, 50, 90))
    return a.join(ranks, "axis", "left")


@query("agg_hot_cohort", f"""WITH {HIST_SQL}, f AS (SELECT c_custkey, c_acctbal, coalesce(commits, 0) AS commits FROM customer LEFT JOIN hist ON id = c_custkey),
t AS (SELECT min(commits) AS thr FROM (SELECT commits FROM f ORDER BY commits DESC LIMIT (SELECT greatest(5, CAST(round_even(count(*) / 10.0, 0) AS BIGINT)) FROM f)))
SELECT count(*) FILTER (commits >= thr) AS cohort, round(avg(c_acctbal) FILTER (commits >= thr), 6) AS cohort_mean, round(avg(c_acctbal), 6) AS baseline FROM f, t""")
def hot_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """Top tenth by churn, five at least, with all ties at the threshold."""
    f = table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(history(spark, sf).withColumnRenamed("id", "c_custkey"), "c_custkey", "left").select("c_acctbal", F.coalesce("commits", F.lit(0)).alias("commits"))
    counts = f.groupBy("commits").agg(F.count(F.lit(1)).alias("n"))
    above = W.orderBy(F.desc("commits")).rowsBetween(W.unboundedPreceding, 0)
    size = F.greatest(F.lit(5).cast("long"), F.bround(F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / 10).cast("long"))
    cut = counts.withColumn("size", size).withColumn("upto", F.sum("n").over(above)).filter("upto >= size").agg(F.max("commits").alias("thr"))
    hot = F.col("commits") >= F.col("thr")
    return f.crossJoin(F.broadcast(cut)).agg(F.count_if(hot).alias("cohort"), F.round(F.avg(F.when(hot, F.col("c_acctbal"))), 6).alias("cohort_mean"), F.round(F.avg("c_acctbal"), 6).alias("baseline"))


@query("agg_majority_purity", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn, sum(n) OVER (PARTITION BY p_brand) AS total FROM c)
SELECT p_brand AS dir, p_type AS cluster, round(n / total, 9) AS purity FROM r WHERE rn = 1""")
def majority_purity(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").filter("p_type is not null").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("p_brand")
    r = c.withColumn("rn", F.row_number().over(own.orderBy(F.desc("n"), "p_type"))).withColumn("total", F.sum("n").over(own))
    return r.filter("rn = 1").select(F.col("p_brand").alias("dir"), F.col("p_type").alias("cluster"), F.round(F.col("n") / F.col("total"), 9).alias("purity"))


@query("agg_hotspots", f"""WITH {HIST_SQL}, m AS (SELECT id, commits / max(commits) OVER () * (authors / max(authors) OVER ()) AS s FROM hist) SELECT id, round(s, 9) AS score FROM m WHERE s > 0 ORDER BY s DESC, id LIMIT 10""")
def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """Product of two max-normalised axes, the ten largest."""
    h = history(spark, sf)
    top = F.broadcast(h.agg(F.max("commits").alias("mc"), F.max("authors").alias("ma")))
    s = h.crossJoin(top).select("id", (F.col("commits") / F.col("mc") * (F.col("authors") / F.col("ma"))).alias("s"))
    return s.filter("s > 0").orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 9).alias("score"))


@query("agg_preview_distribution", "SELECT min(n) AS least, CAST(floor(median(n)) AS INTEGER) AS middle, max(n) AS most FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def preview_distribution(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).cast("int").alias("middle"), F.max("n").alias("most"))


@query("agg_method_histogram", "SELECT m.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('absent')) m(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1")
def method_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over a fixed list of methods, zero where there are none."""
    known = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('purchase'), ('absent') AS t(event_type)")
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


FOLD = 1024  # digests under one digest
DIGEST = "sha256(string_agg({x}, chr(10) ORDER BY {k}))"


@query("agg_fingerprint", f"""WITH a AS (SELECT lang, doc_id // {FOLD} AS k, {DIGEST.format(x="doc_id || chr(31) || sha256(coalesce(text, ''))", k='doc_id')} AS d FROM documents GROUP BY 1, 2),
b AS (SELECT lang, k // {FOLD} AS k, {DIGEST.format(x='d', k='k')} AS d FROM a GROUP BY 1, 2), c AS (SELECT lang, k // {FOLD} AS k, {DIGEST.format(x='d', k='k')} AS d FROM b GROUP BY 1, 2) SELECT lang, {DIGEST.format(x='d', k='k')} AS fingerprint FROM c GROUP BY 1""")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of digests over ranges of ids, three levels high: no row holds more than the lines of one range."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.sha2(F.coalesce("text", F.lit("")), 256))
    d = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("k"), line.alias("d"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "\n"), 256)
    for _ in range(3):
        d = d.groupBy("lang", F.floor(F.col("k") / FOLD).alias("up")).agg(whole.alias("d")).withColumnRenamed("up", "k")
    return d.groupBy("lang").agg(whole.alias("fingerprint"))


@query("agg_health_score", """WITH f AS (SELECT n_nationkey AS id, avg(c_acctbal) / 10000 AS a, count(*) FILTER (c_acctbal > 0) / nullif(count(*), 0) AS b, avg(s_acctbal) / 10000 AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS s_acctbal FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1)
SELECT id, round((coalesce(a * .25, 0) + coalesce(b * .15, 0) + coalesce(c * .2, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE .25 END + CASE WHEN b IS NULL THEN 0 ELSE .15 END + CASE WHEN c IS NULL THEN 0 ELSE .2 END), 0), 6) AS score FROM f""")
def health_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted mean over the factors that are there; weights of the others drop out."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("s"))
    own = c.groupBy("c_nationkey").agg((F.avg("c_acctbal") / 10000).alias("a"), (F.count_if(F.col("c_acctbal") > 0) / F.count(F.lit(1))).alias("b"))
    f = n.join(own, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_nationkey").alias("id"), "a", "b", (F.col("s") / 10000).alias("c"))
    weights = {"a": 0.25, "b": 0.15, "c": 0.2}
    top = sum(F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items())
    base = sum(F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items())
    return f.select("id", F.round(F.try_divide(top, base), 6).alias("score"))


@query("agg_contingency", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("join_nearest_ancestor", f"""WITH {PATH_SQL}, roots AS (SELECT r_name AS root, 1 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
SELECT path, arg_max(root, depth) AS root FROM paths JOIN roots ON starts_with(path, root || '/') GROUP BY path""")
def nearest_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    """The longest root that is a directory above each path: ancestors exploded and joined by equality, no range join."""
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    roots = r.select(F.col("r_name").alias("root"), F.lit(1).alias("depth")).unionByName(n.select(F.concat_ws("/", "r_name", "n_name").alias("root"), F.lit(2).alias("depth")))
    e = paths(spark, sf).select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    return e.join(roots, "root").groupBy("path").agg(F.max_by("root", "depth").alias("root"))


@query("join_probe", "WITH c AS (SELECT c_custkey, unnest([c_custkey * 3, c_custkey * 2, c_custkey]) AS k, unnest([0, 1, 2]) AS pos FROM customer) SELECT c_custkey, arg_min(k, pos) AS hit FROM c JOIN part ON p_partkey = k GROUP BY 1")
def probe(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a row's candidates that exists."""
    c = table(spark, sf, "customer").select("c_custkey", F.posexplode(F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 2, F.col("c_custkey"))).alias("pos", "k"))
    return c.join(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k", "left_semi").groupBy("c_custkey").agg(F.min_by("k", "pos").alias("hit"))


@query("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("join_left_lookup", f"WITH {HIST_SQL} SELECT c_custkey, coalesce(commits, 0) AS commits FROM customer LEFT JOIN hist ON id = c_custkey")
def left_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(history(spark, sf).withColumnRenamed("id", "c_custkey"), "c_custkey", "left").select("c_custkey", F.coalesce("commits", F.lit(0)).alias("commits"))


@query("join_semi", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(p, "l_partkey", "left_semi").join(s, "l_suppkey", "left_semi").select("l_orderkey", "l_partkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, sf, "lineitem").filter("l_quantity > 40").select("l_partkey").distinct())


@query("flt_composite", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#31') AND p_size >= 10 AND contains(lower(p_name), 'a')")
def composite_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#31") & (F.col("p_size") >= 10) & F.contains(F.lower("p_name"), F.lit("a"))).select("p_partkey")


@query("flt_top_segment", f"WITH {PATH_SQL} SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS segment_top FROM paths")
def top_segment(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).select("path", F.when(F.instr("path", "/") == 0, "(root)").otherwise(F.split_part("path", F.lit("/"), F.lit(1))).alias("segment_top"))
