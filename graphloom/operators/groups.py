"""Groups, labels, votes and folds over sets of rows, aggregated before any ranking."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.projections import G1_SQL, HIST_SQL, PATH_SQL, dense_edges, history, paths
from graphloom.registry import query
from graphloom.session import table

# Size of a group that is not split further, redundancy of signals, least overlap for a carried label.
GROUP_CAP = 20
REDUNDANT = 0.8
LEAST_OVERLAP = 0.5
SIGNALS = ("commits", "authors", "balance")


@query("agg_adaptive_groups", f"""WITH {PATH_SQL}, d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n FROM paths GROUP BY 1), e AS (SELECT dir, n, l, array_to_string(string_split(dir, '/')[1:l], '/') AS prefix, len(string_split(dir, '/')) AS deepest FROM d, range(1, 4) r(l)),
p AS (SELECT prefix, sum(n) AS total FROM e GROUP BY 1), c AS (SELECT dir, any_value(n) AS n, arg_min(prefix, l) AS prefix, min(l) AS depth FROM e JOIN p USING (prefix) WHERE total <= {GROUP_CAP} OR l = deepest GROUP BY 1)
SELECT prefix AS grp, depth, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2""")
def adaptive_groups(spark: SparkSession, sf: str, cap: int = GROUP_CAP) -> DataFrame:
    """Folders, split one level deeper while they hold more than the cap and have folders below. Files are counted by folder first."""
    parts = F.split("dir", "/")
    d = paths(spark, sf).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    e = d.select("dir", "n", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).withColumn("grp", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    total = e.groupBy("grp").agg(F.sum("n").alias("total"))
    settled = e.join(total, "grp").filter((F.col("total") <= cap) | (F.col("depth") == F.size(parts)))
    chosen = settled.groupBy("dir").agg(F.min_by(F.struct("grp", "n"), "depth").alias("c"), F.min("depth").cast("long").alias("depth"))
    return chosen.groupBy(F.col("c.grp").alias("grp"), "depth").agg(F.sum("c.n").alias("n"))


@query("st_correlation_matrix", f"WITH {HIST_SQL}, s AS (SELECT commits, authors, c_acctbal AS balance FROM hist JOIN customer ON id = c_custkey), r AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM s" for a, b in combinations(SIGNALS, 2)) + f") SELECT a, b, round(r, 6) AS r, coalesce(abs(r) > {REDUNDANT}, false) AS redundant FROM r")
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of each pair of signals, all in one pass; null without variance."""
    s = history(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), "id")
    pairs = list(combinations(SIGNALS, 2))
    row = s.agg(*(F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs))
    long = row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(f"{a}_{b}", F.lit(None)).alias("r")) for a, b in pairs))))
    return long.select("a", "b", F.round("r", 6).alias("r"), F.coalesce(F.abs("r") > REDUNDANT, F.lit(False)).alias("redundant"))


@query("gr_cluster_labels", f"WITH {PATH_SQL}, c AS (SELECT segment, regexp_extract(path, '^[^/]+/[^/]+') AS prefix, count(*) AS n FROM paths GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, prefix) AS k, sum(n) OVER (PARTITION BY segment) AS members FROM c) SELECT segment, prefix AS label, CAST(members AS BIGINT) AS members FROM r WHERE k = 1")
def cluster_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The folder with most members of each cluster, the least of equals."""
    c = paths(spark, sf).groupBy("segment", F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("segment").agg(F.min_by("prefix", F.struct((-F.col("n")).alias("n"), "prefix")).alias("label"), F.sum("n").alias("members"))


@query("gr_cluster_stability", "SELECT c_nationkey AS cluster, count(*) AS members, count(DISTINCT c_mktsegment) = 1 AS stable FROM customer GROUP BY 1")
def cluster_stability(spark: SparkSession, sf: str) -> DataFrame:
    """A cluster is stable where all of its members lie together in a second partition."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cluster"), "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("cluster").agg(F.sum("n").alias("members"), (F.count("c_mktsegment") == 1).alias("stable"))


@query("gr_sorted_clusters", "WITH c AS (SELECT p_brand, count(*) AS size, min(p_partkey) AS first FROM part GROUP BY 1) SELECT p_brand, size, CAST(row_number() OVER (ORDER BY size DESC, first) - 1 AS INTEGER) AS place FROM c")
def sorted_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by size, then by their least member; only one row a cluster is ranked."""
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("size"), F.min("p_partkey").alias("first"))
    return c.select("p_brand", "size", (F.row_number().over(W.orderBy(F.desc("size"), "first")) - 1).alias("place"))


@query("gr_directory_graph", f"WITH {G1_SQL} SELECT a.p_brand AS src_dir, b.p_brand AS dst_dir, count(*) AS edges, a.p_brand = b.p_brand AS internal FROM g1 JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey GROUP BY 1, 2")
def directory_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the folders that stand for their files, with those inside a folder apart."""
    p = table(spark, sf, "part")
    named = lambda end: p.select(F.col("p_partkey").alias(end), F.col("p_brand").alias(f"{end}_dir"))
    e = dense_edges(spark, sf).join(named("src"), "src").join(named("dst"), "dst").groupBy("src_dir", "dst_dir").agg(F.count(F.lit(1)).alias("edges"))
    return e.withColumn("internal", F.col("src_dir") == F.col("dst_dir"))


@query("agg_kind_vote", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_type, (-n, p_type)) AS kind FROM c GROUP BY 1")
def kind_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Most common kind of a group; equals go to the first in order."""
    c = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_brand").agg(F.min_by("p_type", F.struct((-F.col("n")).alias("n"), "p_type")).alias("kind"))


@query("join_label_carry", f"""WITH c AS (SELECT c_nationkey AS old, c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS new, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY old) AS share FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY share DESC, old) AS k FROM s WHERE share >= {LEAST_OVERLAP})
SELECT new, old AS label, round(share, 6) AS share FROM b WHERE k = 1""")
def label_carry(spark: SparkSession, sf: str) -> DataFrame:
    """A new cluster takes the label of the old one of which it holds most, half at least."""
    new = F.col("c_nationkey") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("old"), new.alias("new")).agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("n") / F.sum("n").over(W.partitionBy("old"))).alias("share")
    best = F.max_by(F.struct("old", "share"), F.struct("share", (-F.col("old")).alias("o"))).alias("b")
    return c.select("old", "new", share).filter(F.col("share") >= LEAST_OVERLAP).groupBy("new").agg(best).select("new", F.col("b.old").alias("label"), F.round("b.share", 6).alias("share"))


@query("er_assignment_repair", "WITH c AS (SELECT l_partkey, min(l_orderkey) AS claimed_by, count(*) AS claims FROM lineitem GROUP BY 1) SELECT p_partkey, claimed_by, coalesce(claims, 0) AS claims, claimed_by IS NULL AS recovered FROM part LEFT JOIN c ON p_partkey = l_partkey")
def assignment_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The first claim to a known item wins, invented items go, items without a claim are recovered."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("claimed_by"), F.count(F.lit(1)).alias("claims"))
    j = table(spark, sf, "part").select("p_partkey").join(c, "p_partkey", "left")
    return j.select("p_partkey", "claimed_by", F.coalesce("claims", F.lit(0)).alias("claims"), F.col("claimed_by").isNull().alias("recovered"))


@query("misc_toggle_fold", "WITH l AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS topic, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2) SELECT user_id, topic FROM l WHERE last = 'click'")
def toggle_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that are checked after all toggles: the last action on each decides."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "error"))
    last = e.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("topic")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.filter("last = 'click'").select("user_id", "topic")


@query("misc_seeded_sample", "SELECT item_id FROM benchmark ORDER BY md5('17:' || item_id), item_id LIMIT 5")
def seeded_sample(spark: SparkSession, sf: str, seed: int = 17, n: int = 5) -> DataFrame:
    """A few rows in the order of a seeded digest, so that reruns agree."""
    return table(spark, sf, "benchmark").select("item_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("item_id").cast("string"))), "item_id").limit(n)


@query("misc_verdict", "SELECT event_type, median(value) >= 100 AND NOT bool_or(value < 0) AS accepted FROM events GROUP BY 1")
def verdict(spark: SparkSession, sf: str, target: float = 100) -> DataFrame:
    """Accepted where the median meets the target and no run fails hard.

    Counts on either side of the target place the median; where they are even, its two neighbours decide.
    """
    v = F.col("value")
    n, above = F.count(v), F.count_if(v >= target)
    met = F.when(2 * above != n, 2 * above > n).otherwise(F.max(F.when(v < target, v)) + F.min(F.when(v >= target, v)) >= 2 * target)
    return table(spark, sf, "events").groupBy("event_type").agg((met & ~F.bool_or(v < 0)).alias("accepted"))


@query("misc_frequency_order", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, CAST(row_number() OVER (ORDER BY n DESC, lang) AS INTEGER) AS colour FROM c")
def frequency_order(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return c.select("lang", "n", F.row_number().over(W.orderBy(F.desc("n"), F.asc_nulls_last("lang"))).alias("colour"))


@query("srt_crutch_words", """WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT conv_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) <= 5""")
def crutch_words(spark: SparkSession, sf: str) -> DataFrame:
    """The five most frequent words of a talk among those said three times or more."""
    w = table(spark, sf, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("word"))
    c = w.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    k = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "word"))
    return c.withColumn("k", k).filter("k <= 5").select("conv_id", "word", "n")


@query("stm_stage_durations", "SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS micros FROM events")
def stage_durations(spark: SparkSession, sf: str) -> DataFrame:
    """From each mark to the next of its job; null for the last."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", (F.lead(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


@query("stm_mission_top_up", "SELECT user_id, CAST(greatest(0, least(3 - count(*) FILTER (event_type = 'signup'), 10 - count(*))) AS BIGINT) AS missing FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1")
def mission_top_up(spark: SparkSession, sf: str) -> DataFrame:
    """New missions due: up to three active, within ten in all."""
    e = table(spark, sf, "events").filter(F.col("ts") >= F.to_timestamp(F.lit("2024-01-29")))
    return e.groupBy("user_id").agg(F.greatest(F.lit(0).cast("long"), F.least(3 - F.count_if(F.col("event_type") == "signup"), 10 - F.count(F.lit(1)))).alias("missing"))


@query("win_clean_streak", """WITH b AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT user_id, max(ts) FROM events GROUP BY 1 UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'error'), g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM b)
SELECT user_id, max(gap) AS micros FROM g GROUP BY 1""")
def clean_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Longest time without an error, the first and last event being its outer bounds."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ends = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("user_id", F.explode(F.array("a", "b")).alias("t"))
    marks = e.filter("event_type = 'error'").select("user_id", "t").unionByName(ends)
    gaps = marks.select("user_id", (F.col("t") - F.lag("t").over(W.partitionBy("user_id").orderBy("t"))).alias("gap"))
    return gaps.groupBy("user_id").agg(F.max("gap").alias("micros"))


@query("str_skill_name", """WITH a AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name || 's (C++/Node.js) class'), '[^a-z0-9+#/. ]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '[a-z]{3,}[a-rt-z]?s') AND length(x) > 3 AND NOT ends_with(x, 'ss') THEN left(x, length(x) - 1) ELSE x END), ' ') AS skill FROM a""")
def skill_name(spark: SparkSession, sf: str) -> DataFrame:
    """Lower case, only [a-z0-9+#/. ], single spaces; tokens of over three letters lose one final s, unless they end in ss."""
    kept = F.regexp_replace(F.lower(F.concat("p_name", F.lit("s (C++/Node.js) class"))), "[^a-z0-9+#/. ]", " ")
    words = F.split(F.trim(F.regexp_replace(kept, r"\s+", " ")), " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(words, lambda x: F.regexp_replace(x, "^([a-z]{2,}[a-rt-z])s$", "$1")), " ").alias("skill"))


@query("flt_blocklist", "SELECT page_id FROM pages WHERE regexp_extract(lower(url), '^https?://([^/?#]+)', 1) NOT IN (SELECT DISTINCT regexp_extract(lower(url), '^https?://([^/?#]+)', 1) FROM pages WHERE page_id < 3)")
def blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose host, in any case, is not on a list."""
    host = F.regexp_extract(F.lower("url"), "^https?://([^/?#]+)", 1).alias("host")
    p = table(spark, sf, "pages").select("page_id", host)
    return p.join(p.filter("page_id < 3").select("host").distinct(), "host", "left_anti").select("page_id")


@query("math_truncated_ratio", "SELECT p_partkey, floor(p_retailprice / (p_size + 1) * 10) / 10 AS ratio FROM part")
def truncated_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """One decimal, cut and not rounded."""
    return table(spark, sf, "part").select("p_partkey", (F.floor(F.col("p_retailprice") / (F.col("p_size") + 1) * 10) / 10).alias("ratio"))
