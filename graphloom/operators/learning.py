"""Learning records: maps of topics, assessments, reviews, awards, missions, lists and overlays, from orders and events.

An order stands for a map, its lines for the nodes; an event for an attempt, with a score from its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import FINGERPRINT_SQL, fingerprint
from graphloom.plans.projections import FILES_SQL, files
from graphloom.registry import query
from graphloom.session import table

# Least score to pass, experience of a completed map, deepest level of maps, lists' lengths.
PASS, PARENT_BONUS, MOST_DEPTH = 70, 100, 2
MOST_MISSED, MOST_HISTORY, MOST_VAULT, PREVIEW = 4, 50, 100, 500
INTERVALS = (1, 3, 7, 21, 60)
NOW = "2024-01-31 00:00:00"


@query("misc_roadmap_serialise", "WITH n AS (SELECT l_orderkey, l_linestatus AS stage, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nodes FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, list(stage ORDER BY stage) AS stages, list(nodes ORDER BY stage) AS nodes, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = n.l_orderkey AND l_linestatus = 'F') AS done FROM n GROUP BY 1")
def roadmap_serialise(spark: SparkSession, sf: str) -> DataFrame:
    """A map's nodes by stage, nested and in order, with how many are done."""
    n = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("stage")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("m"))
    s = F.array_sort(F.collect_list(F.struct("stage", F.transform("m", lambda x: x["l_partkey"]).alias("nodes"))))
    return n.groupBy("l_orderkey").agg(F.transform(s, lambda x: x["stage"]).alias("stages"), F.transform(s, lambda x: x["nodes"]).alias("nodes"), F.coalesce(F.sum(F.when(F.col("stage") == "F", F.size("m"))), F.lit(0)).alias("done"))


@query("misc_search_precedence", "WITH c AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS seed, min(o_orderkey) FILTER (o_orderstatus = 'O') AS cached FROM orders GROUP BY 1) SELECT o_custkey, coalesce(seed, cached) AS found, CASE WHEN seed IS NOT NULL THEN 'seed' WHEN cached IS NOT NULL THEN 'cached' ELSE 'none' END AS source FROM c")
def search_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """A curated map before a cached one; what would be generated is none."""
    own = lambda s: F.min(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(own("F").alias("seed"), own("O").alias("cached"))
    return c.select("o_custkey", F.coalesce("seed", "cached").alias("found"), F.when(F.col("seed").isNotNull(), "seed").when(F.col("cached").isNotNull(), "cached").otherwise("none").alias("source"))


@query("misc_browse", "SELECT o_orderkey, o_orderpriority AS title, CAST(round_even(100.0 * count(*) FILTER (l_linestatus = 'F') / greatest(count(l_orderkey), 1), 0) AS BIGINT) AS percent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def browse(spark: SparkSession, sf: str) -> DataFrame:
    """Every map with its percentage, those without nodes too."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    j = table(spark, sf, "orders").join(n, "o_orderkey", "left")
    return j.select("o_orderkey", F.col("o_orderpriority").alias("title"), F.coalesce(F.bround(100 * F.col("done") / F.col("n")), F.lit(0.0)).cast("long").alias("percent"))


@query("misc_root_maps", "SELECT o_orderkey, o_custkey FROM orders WHERE nullif(o_orderkey % 4, 0) IS NULL")
def root_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maps without a parent."""
    parent = F.nullif(F.col("o_orderkey") % 4, F.lit(0))
    return table(spark, sf, "orders").filter(parent.isNull()).select("o_orderkey", "o_custkey")


@query("misc_assessment", "WITH q AS (SELECT l_orderkey, l_linenumber % 4 AS answer, CASE WHEN l_quantity > 40 THEN -1 ELSE (l_linenumber + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) % 4 END AS given, l_returnflag AS topic FROM lineitem), s AS (SELECT l_orderkey, CAST(round_even(100.0 * count(*) FILTER (given = answer) / greatest(1, count(*)), 0) AS BIGINT) AS score, list_sort(list_distinct(list(topic) FILTER (given <> answer))) AS weak FROM q GROUP BY 1) SELECT l_orderkey, score, score >= 70 AS passed, CASE WHEN score >= 70 THEN CAST(round_even(150 + 250 * (score - 70) / 100.0, 0) AS BIGINT) ELSE 0 END AS xp, coalesce(weak, []) AS weak FROM s")
def assessment(spark: SparkSession, sf: str) -> DataFrame:
    """Score, pass, experience and topics to look at again; a question left open counts as wrong."""
    answer = F.col("l_linenumber") % 4
    given = F.when(F.col("l_quantity") > 40, -1).otherwise((F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) % 4)
    q = table(spark, sf, "lineitem").select("l_orderkey", (given == answer).alias("ok"), F.col("l_returnflag").alias("topic"))
    s = q.groupBy("l_orderkey").agg(F.bround(100 * F.count_if("ok") / F.greatest(F.lit(1), F.count(F.lit(1)))).cast("long").alias("score"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("topic")))).alias("weak"))
    xp = F.when(F.col("score") >= PASS, F.bround(150 + 250 * (F.col("score") - PASS) / 100).cast("long")).otherwise(F.lit(0).cast("long"))
    return s.select("l_orderkey", "score", (F.col("score") >= PASS).alias("passed"), xp.alias("xp"), "weak")


@query("misc_screening", "WITH m AS (SELECT l_orderkey, round_even(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 0) AS mcq, count(*) % 11 AS judged FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(mcq AS BIGINT) AS mcq, CAST(round_even((judged + round_even(mcq / 10, 0)) / 2, 0) AS BIGINT) AS technical FROM m")
def screening(spark: SparkSession, sf: str) -> DataFrame:
    """A screening's percentage, and its blend with a judged score of ten."""
    m = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bround(100 * F.count_if(F.col("l_linestatus") == "F") / F.count(F.lit(1))).alias("mcq"), (F.count(F.lit(1)) % 11).alias("judged"))
    return m.select("l_orderkey", F.col("mcq").cast("long").alias("mcq"), F.bround((F.col("judged") + F.bround(F.col("mcq") / 10)) / 2).cast("long").alias("technical"))


@query("misc_parent_bonus", "WITH c AS (SELECT l_orderkey, bool_and(l_linestatus IN ('F')) AS complete FROM lineitem GROUP BY 1), p AS (SELECT o_custkey, count(*) AS children, count(*) FILTER (complete) AS complete FROM orders JOIN c ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_custkey, children = complete AS parent_complete, CASE WHEN children = complete THEN 100 ELSE 0 END AS bonus FROM p")
def parent_bonus(spark: SparkSession, sf: str) -> DataFrame:
    """A node is complete when all nodes of all maps below it are; that is worth a bonus."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("complete"))
    p = table(spark, sf, "orders").join(c, "o_orderkey").groupBy("o_custkey").agg(F.bool_and("complete").alias("parent_complete"))
    return p.select("o_custkey", "parent_complete", F.when(F.col("parent_complete"), PARENT_BONUS).otherwise(0).alias("bonus"))


@query("misc_expandable_nodes", "SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_orderkey % 4 < 2 AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A')")
def expandable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that may get a map below them: of maps that aren't too deep, without one so far."""
    line = table(spark, sf, "lineitem")
    n = line.filter(F.col("l_orderkey") % 4 < MOST_DEPTH).select("l_orderkey", "l_linenumber").distinct()
    return n.join(line.filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "left_anti")


@query("misc_review_cards", "WITH m AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS term, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY 1, 2), n AS (SELECT * FROM m WHERE (user_id, term) NOT IN (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'view')) SELECT user_id, term FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY first) <= 4")
def review_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The first four terms missed that have no card yet, each once."""
    e = table(spark, sf, "events").withColumn("term", F.get_json_object("props", "$.k").cast("long"))
    m = e.filter("event_type = 'error'").groupBy("user_id", "term").agg(F.min("event_id").alias("first"))
    n = m.join(e.filter("event_type = 'view'").select("user_id", "term"), ["user_id", "term"], "left_anti")
    return n.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("first"))).filter(F.col("k") <= MOST_MISSED).select("user_id", "term")


@query("misc_speaking_overall", "SELECT user_id, CAST(round_even(avg(a) * 10, 0) AS BIGINT) AS overall FROM (SELECT user_id, event_type, avg(event_id % 11) AS a FROM events WHERE event_type <> 'error' GROUP BY 1, 2) GROUP BY 1")
def speaking_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Ten times the mean of the numeric dimensions of a score map, halves to even; users without any have no row.

    The mean is rounded to twelve digits first, so that a half is one in whatever order the dimensions are added.
    """
    m = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg(F.col("event_id") % 11).alias("a"))
    g = m.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.when(F.col("event_type") != "error", F.col("a"))))).alias("m"))
    g = g.select("user_id", F.filter(F.map_values("m"), lambda x: x.isNotNull()).alias("v")).filter(F.size("v") > 0)
    return g.select("user_id", F.bround(F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v") * 10, 12)).cast("long").alias("overall"))


@query("misc_speech_history", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 50")
def speech_history(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", "value", k.alias("k")).filter(F.col("k") <= MOST_HISTORY).drop("k")


@query("misc_vault_entries", "SELECT doc_id, left(coalesce(text, ''), 500) AS preview FROM documents ORDER BY doc_id DESC LIMIT 100")
def vault_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The latest hundred, with the first 500 characters to show."""
    return table(spark, sf, "documents").orderBy(F.desc("doc_id")).limit(MOST_VAULT).select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(PREVIEW)).alias("preview"))


@query("misc_target_list", "SELECT c_custkey, c_name, count(o_orderkey) AS nodes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def target_list(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("nodes"))
    return table(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("nodes", F.lit(0)).alias("nodes"))


DUE_SQL = f"""rv AS (SELECT user_id, event_id, ts, [1, 3, 7, 21, 60][event_id % 5 + 1] AS days, ts + INTERVAL 1 DAY * [1, 3, 7, 21, 60][event_id % 5 + 1] AS due FROM events),
st AS (SELECT *, CASE WHEN due >= TIMESTAMP '{NOW}' THEN 1.0 ELSE greatest(.15, 1 - (epoch(TIMESTAMP '{NOW}') - epoch(due)) / (1.5 * days * 86400)) END AS strength FROM rv)"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, event_id, days, due, strength: whole until due, then less by the time over, .15 at least."""
    days = F.get(F.array(*map(F.lit, INTERVALS)), (F.col("event_id") % 5).cast("int"))
    r = table(spark, sf, "events").select("user_id", "event_id", days.alias("days"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + days.cast("long") * 86_400_000_000).alias("due"))
    over = (F.unix_micros(F.to_timestamp(F.lit(NOW))) - F.unix_micros("due")) / 1e6
    return r.withColumn("strength", F.when(over <= 0, 1.0).otherwise(F.greatest(F.lit(0.15), 1 - over / (1.5 * F.col("days") * 86_400))))


@query("misc_due_list", f"WITH {DUE_SQL} SELECT user_id, event_id, round(CAST(strength AS DOUBLE), 6) AS strength, row_number() OVER (PARTITION BY user_id ORDER BY due, event_id) AS position FROM st WHERE due <= TIMESTAMP '{NOW}'")
def due_list(spark: SparkSession, sf: str) -> DataFrame:
    """What is due, earliest first, and how much is remembered."""
    r = reviews(spark, sf).filter(F.col("due") <= F.to_timestamp(F.lit(NOW)))
    return r.select("user_id", "event_id", F.round("strength", 6).alias("strength"), F.row_number().over(W.partitionBy("user_id").orderBy("due", "event_id")).alias("position"))


@query("stm_review_strength", f"WITH {DUE_SQL} SELECT c_custkey AS user_id, count(*) FILTER (due <= TIMESTAMP '{NOW}') AS due, round(CAST(coalesce(avg(strength), 1.0) AS DOUBLE), 6) AS strength FROM customer LEFT JOIN st ON user_id = c_custkey GROUP BY 1")
def review_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews due and mean strength of every learner; one without any is at full strength."""
    r = reviews(spark, sf).groupBy("user_id").agg(F.count_if(F.col("due") <= F.to_timestamp(F.lit(NOW))).alias("due"), F.avg("strength").alias("s"))
    j = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(r, "user_id", "left")
    return j.select("user_id", F.coalesce("due", F.lit(0)).alias("due"), F.round(F.coalesce("s", F.lit(1.0)), 6).alias("strength"))


@query("date_next_review", "SELECT event_id, CASE WHEN event_id % 101 >= 70 THEN least(event_id % 5 + 1, 4) ELSE 0 END AS step, CAST(ts AS DATE) + [1, 3, 7, 21, 60][CASE WHEN event_id % 101 >= 70 THEN least(event_id % 5 + 1, 4) ELSE 0 END + 1] AS due FROM events")
def next_review(spark: SparkSession, sf: str) -> DataFrame:
    """A pass goes one interval on, a failure back to the first, and the day that follows from it."""
    step = F.when(F.col("event_id") % 101 >= PASS, F.least(F.col("event_id") % 5 + 1, F.lit(4).cast("long"))).otherwise(F.lit(0).cast("long"))
    return table(spark, sf, "events").select("event_id", step.alias("step"), F.date_add(F.to_date("ts"), F.get(F.array(*map(F.lit, INTERVALS)), step.cast("int"))).alias("due"))


# Awards by what they take.
AWARDS = {"first_steps": ("done", 1), "ten_nodes": ("done", 10), "level_5": ("level", 5), "level_10": ("level", 10), "first_interview": ("interviews", 1), "first_speech": ("speeches", 1)}
FACTS_SQL = "ft AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) * 50 // 500 + 1 AS level, count(*) FILTER (event_type = 'signup') AS interviews, count(*) FILTER (event_type = 'view') AS speeches FROM events GROUP BY 1), rl(code, fact, least) AS (VALUES " + ", ".join(f"('{c}', '{f}', {n})" for c, (f, n) in AWARDS.items()) + "), lg AS (SELECT user_id, unnest(['done', 'level', 'interviews', 'speeches']) AS fact, unnest([done, level, interviews, speeches]) AS v FROM ft), hv AS (SELECT DISTINCT user_id, 'first_steps' AS code FROM events WHERE user_id % 2 = 0)"


def awards(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, code of every award that a user's facts reach."""
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    f = table(spark, sf, "events").groupBy("user_id").agg(is_("purchase").alias("done"), (F.floor(F.count(F.lit(1)) * 50 / 500) + 1).alias("level"), is_("signup").alias("interviews"), is_("view").alias("speeches"))
    rules = F.array(*(F.struct(F.lit(c).alias("code"), (F.col(k) >= n).alias("met")) for c, (k, n) in AWARDS.items()))
    return f.select("user_id", F.inline(rules)).filter("met").select("user_id", "code")


def held(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("user_id % 2 = 0").select("user_id").distinct().withColumn("code", F.lit("first_steps"))


@query("agg_achievements", f"WITH {FACTS_SQL} SELECT lg.user_id, rl.code FROM lg JOIN rl USING (fact) WHERE v >= least AND (lg.user_id, rl.code) NOT IN (SELECT user_id, code FROM hv)")
def achievements(spark: SparkSession, sf: str) -> DataFrame:
    """Awards that are new."""
    return awards(spark, sf).join(held(spark, sf), ["user_id", "code"], "left_anti")


@query("misc_achievement_list", f"WITH {FACTS_SQL}, u AS (SELECT DISTINCT user_id FROM events), ok AS (SELECT lg.user_id, rl.code FROM lg JOIN rl USING (fact) WHERE v >= least UNION SELECT * FROM hv) SELECT u.user_id, rl.code, ok.code IS NOT NULL AS unlocked, row_number() OVER (PARTITION BY u.user_id ORDER BY ok.code IS NULL, rl.code) AS position FROM u CROSS JOIN rl LEFT JOIN ok ON ok.user_id = u.user_id AND ok.code = rl.code")
def achievement_list(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule for every user, locked ones last."""
    ok = awards(spark, sf).union(held(spark, sf)).distinct().withColumn("unlocked", F.lit(True))
    u = table(spark, sf, "events").select("user_id").distinct().withColumn("code", F.explode(F.array(*map(F.lit, AWARDS))))
    j = u.join(ok, ["user_id", "code"], "left").withColumn("unlocked", F.coalesce("unlocked", F.lit(False)))
    return j.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("unlocked"), "code")))


@query("misc_positional_reorder", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
def positional_reorder(spark: SparkSession, sf: str) -> DataFrame:
    """A list of ids in their new order, and the rows with the positions that follow from it."""
    order = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("ids"))
    return order.select("o_custkey", F.posexplode(F.transform("ids", lambda x: x["o_orderkey"])).alias("position", "o_orderkey"))


@query("misc_label_overlay", "SELECT p_brand AS cluster, coalesce(max(p_name) FILTER (p_size = 50), min(p_type), 'cluster ' || p_brand) AS label FROM part GROUP BY 1")
def label_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A label of one's own before the folder's, before a number."""
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.max(F.when(F.col("p_size") == 50, F.col("p_name"))).alias("custom"), F.min("p_type").alias("prefix"))
    return p.select("cluster", F.coalesce("custom", "prefix", F.concat(F.lit("cluster "), "cluster")).alias("label"))


@query("misc_deletion_verdict", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'outside the folder' WHEN s_nationkey % 3 = 0 THEN 'shared' WHEN s_suppkey % 2 = 0 THEN 'not a clone' ELSE 'delete' END AS verdict FROM supplier")
def deletion_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The first reason that keeps a folder; without any it may go."""
    return table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 0, "outside the folder").when(F.col("s_nationkey") % 3 == 0, "shared").when(F.col("s_suppkey") % 2 == 0, "not a clone").otherwise("delete").alias("verdict"))


@query("misc_marker_split", f"WITH {FILES_SQL}, m AS (SELECT id, unnest(['size', 'depth', 'cycle']) AS k, unnest([(id % 3) / 2.0, (id % 5) / 4.0, CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 2) / 1.0 END]) AS v FROM files) SELECT id, coalesce(list(k ORDER BY -v, k) FILTER (v > 0), []) AS fired, coalesce(list(k ORDER BY k) FILTER (v = 0), []) AS clean, coalesce(list(k ORDER BY k) FILTER (v IS NULL), []) AS no_input FROM m GROUP BY 1")
def marker_split(spark: SparkSession, sf: str) -> DataFrame:
    """A file's markers: fired by severity, clean, and those without input."""
    k = F.col("id")
    m = F.array(*(F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (("size", (k % 3) / 2.0), ("depth", (k % 5) / 4.0), ("cycle", F.when(k % 7 != 0, (k % 2) / 1.0)))))
    names = lambda a: F.transform(a, lambda x: x["k"])
    fired = F.array_sort(F.transform(F.filter("m", lambda x: x["v"] > 0), lambda x: F.struct((-x["v"]).alias("o"), x["k"].alias("k"))))
    return files(spark, sf).select("id", m.alias("m")).select("id", names(fired).alias("fired"), F.array_sort(names(F.filter("m", lambda x: x["v"] == 0))).alias("clean"), F.array_sort(names(F.filter("m", lambda x: x["v"].isNull()))).alias("no_input"))


@query("misc_cohort_sentence", "SELECT c_mktsegment AS segment, printf('%d hot files average %.1f against %.1f', count(*) FILTER (c_acctbal > 9000), avg(c_acctbal) FILTER (c_acctbal > 9000) / 1000, avg(c_acctbal) / 1000) AS sentence FROM customer GROUP BY 1")
def cohort_sentence(spark: SparkSession, sf: str) -> DataFrame:
    hot = F.col("c_acctbal") > 9000
    g = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(hot).alias("n"), (F.avg(F.when(hot, F.col("c_acctbal"))) / 1000).alias("h"), (F.avg("c_acctbal") / 1000).alias("a"))
    return g.select("segment", F.format_string("%d hot files average %.1f against %.1f", "n", "h", "a").alias("sentence"))


@query("misc_distinct_lists", f"WITH {FILES_SQL} SELECT list_sort(list_distinct(list(split_part(path, '/', 1)))) AS segments, list_sort(list_distinct(list(regexp_extract(path, '\\.([a-z]+)$', 1)))) AS extensions, list_sort(list_distinct(list(cluster))) AS clusters FROM files")
def distinct_lists(spark: SparkSession, sf: str) -> DataFrame:
    """What a list can be filtered by: a few values of each kind."""
    f = files(spark, sf)
    return f.agg(F.array_sort(F.collect_set(F.substring_index("path", "/", 1))).alias("segments"), F.array_sort(F.collect_set(F.regexp_extract("path", r"\.([a-z]+)$", 1))).alias("extensions"), F.array_sort(F.collect_set("cluster")).alias("clusters"))


@query("misc_edit_overlay", f"WITH {FILES_SQL}, e AS (SELECT id, cluster AS parent, CASE WHEN id % 19 = 0 THEN 'Brand#1' WHEN id % 23 = 0 THEN 'nowhere' END AS moved, id % 29 = 0 AS deleted FROM files), t AS (SELECT id, CASE WHEN moved IN (SELECT cluster FROM files) THEN moved ELSE parent END AS parent FROM e WHERE NOT deleted) SELECT parent, count(*) AS children, count(*) > 8 AS too_many FROM t GROUP BY 1")
def edit_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A two-level tree after edits: deletions, moves to parents that exist, and a warning where a parent has too many."""
    f = files(spark, sf)
    e = f.select("id", F.col("cluster").alias("parent"), F.when(F.col("id") % 19 == 0, "Brand#1").when(F.col("id") % 23 == 0, "nowhere").alias("moved")).filter(F.col("id") % 29 != 0)
    known = f.select(F.col("cluster").alias("moved")).distinct().withColumn("ok", F.lit(True))
    t = e.join(known, "moved", "left").select(F.when(F.col("ok"), F.col("moved")).otherwise(F.col("parent")).alias("parent"))
    n = F.count(F.lit(1))
    return t.groupBy("parent").agg(n.alias("children"), (n > 8).alias("too_many"))


@query("er_graph_patch", f"WITH {FILES_SQL}, d AS (SELECT DISTINCT cluster FROM files WHERE cluster LIKE '%2'), k AS (SELECT id, CASE WHEN cluster IN (SELECT cluster FROM d) THEN NULL ELSE cluster END AS parent, CASE WHEN id % 10 = 0 THEN .5 ELSE (id % 7) / 7.0 END AS weight FROM files) SELECT id, coalesce(parent, '(top)') AS parent, round(CAST(weight AS DOUBLE), 6) AS weight FROM k UNION ALL SELECT -1, '(top)', 1.0")
def graph_patch(spark: SparkSession, sf: str) -> DataFrame:
    """A patch as sets: children of deleted parents go to the top, some weights change, one node is added."""
    f = files(spark, sf)
    gone = f.filter(F.endswith("cluster", F.lit("2"))).select("cluster").distinct().withColumn("gone", F.lit(True))
    k = f.join(gone, "cluster", "left").select("id", F.when(F.col("gone"), "(top)").otherwise(F.col("cluster")).alias("parent"), F.round(F.when(F.col("id") % 10 == 0, 0.5).otherwise((F.col("id") % 7) / 7.0), 6).alias("weight"))
    return k.unionByName(spark.createDataFrame([(-1, "(top)", 1.0)], "id long, parent string, weight double"))


@query("misc_expandable_dirs", f"WITH {FILES_SQL}, d AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS sub FROM files) SELECT dir, count(*) AS below FROM d GROUP BY 1 HAVING count(*) > 1")
def expandable_dirs(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("path", "/")
    d = files(spark, sf).select(F.get(parts, 0).alias("dir"), F.get(parts, 1).alias("sub")).distinct()
    return d.groupBy("dir").agg(F.count(F.lit(1)).alias("below")).filter("below > 1")


@query("misc_folder_reconcile", f"WITH {FILES_SQL}, g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n FROM files GROUP BY 1) SELECT count(*) AS folders, CAST(sum(n) AS BIGINT) AS grouped, (SELECT count(*) FROM files) AS total, sum(n) = (SELECT count(*) FROM files) AS conserved FROM g")
def folder_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Files grouped by folder, and whether none was lost or counted twice."""
    f = files(spark, sf)
    g = f.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("folders"), F.sum("n").alias("grouped"))
    return g.crossJoin(f.agg(F.count(F.lit(1)).alias("total"))).withColumn("conserved", F.col("grouped") == F.col("total"))  # one row each


@query("misc_fingerprint_check", f"WITH f AS (SELECT item_id, {FINGERPRINT_SQL.format(x='text')} AS f FROM benchmark) SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'unverified' WHEN item_id % 3 = 1 THEN 'match' ELSE 'mismatch' END AS state, f AS actual FROM f")
def fingerprint_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an address names the text that it leads to: unverified without a fingerprint, as old addresses have none."""
    b = table(spark, sf, "benchmark").select("item_id", fingerprint(F.col("text")).alias("actual"))
    stored = F.when(F.col("item_id") % 3 == 1, F.col("actual")).when(F.col("item_id") % 3 == 2, "stale")
    return b.select("item_id", F.when(stored.isNull() | (stored == ""), "unverified").when(stored == F.col("actual"), "match").otherwise("mismatch").alias("state"), "actual")


@query("misc_reading_sort", "SELECT c_custkey FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 50")
def reading_sort(spark: SparkSession, sf: str, size: int = 25, page: int = 3) -> DataFrame:
    """A page of a list sorted downwards, a missing value below all others."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return c.orderBy(F.desc_nulls_last("v"), "c_custkey").offset(size * (page - 1)).limit(size).select("c_custkey")


@query("srt_page_window", "WITH p AS (SELECT event_type, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM events GROUP BY 1) SELECT event_type, pages, greatest(1, least(3, pages) - 2) AS first_shown, least(pages, greatest(1, least(3, pages) - 2) + 4) AS last_shown FROM p")
def page_window(spark: SparkSession, sf: str, page: int = 3, size: int = 25, width: int = 5) -> DataFrame:
    """How many pages a list has, and which are offered around the current one."""
    p = table(spark, sf, "events").groupBy("event_type").agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))
    first = F.greatest(F.lit(1).cast("long"), F.least(F.lit(page).cast("long"), "pages") - width // 2)
    return p.select("event_type", "pages", first.alias("first_shown"), F.least("pages", first + width - 1).alias("last_shown"))


@query("misc_forecast_total", "SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1)")
def forecast_total(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").filter(F.col("ts") >= F.to_timestamp(F.lit("2024-01-24"))).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.sum("n").alias("total"))


@query("misc_briefing", "SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS week, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1")
def briefing(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count_if(F.to_date("ts") == F.to_date(F.lit("2024-01-30"))).alias("today"), F.count_if(F.col("ts") >= F.to_timestamp(F.lit("2024-01-24"))).alias("week"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))


@query("agg_dashboard", "WITH s AS (SELECT user_id, event_type, least(5, count(*)) AS v FROM events GROUP BY 1, 2), k AS (SELECT user_id, avg(v) AS a, sum(v) FILTER (contains(event_type, 'ai') OR contains(event_type, 'rag') OR contains(event_type, 'er')) AS ai, count(*) AS n FROM s GROUP BY 1), d AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS talks, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1) SELECT user_id, CAST(round_even(a / 5 * 100, 0) AS BIGINT) AS technical_depth, least(100, 25 * talks) AS presentation, CAST(round_even(coalesce(ai, 0) / greatest(1, n) * 20, 0) AS BIGINT) AS ai_knowledge, least(100, 10 * days) AS consistency FROM k JOIN d USING (user_id)")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """A learner's composite: mean of skills, those with a word in their name, talks and days, each up to 100."""
    e = table(spark, sf, "events")
    s = e.groupBy("user_id", "event_type").agg(F.least(F.lit(5).cast("long"), F.count(F.lit(1))).alias("v"))
    k = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    days = e.select("user_id", F.to_date("ts").alias("d")).distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("days"))
    talks = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("talks"))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, v: a + v)
    keyed = F.map_filter("m", lambda n, v: F.contains(n, F.lit("ai")) | F.contains(n, F.lit("rag")) | F.contains(n, F.lit("er")))
    size = F.size(F.map_values("m"))
    j = k.join(days, "user_id").join(talks, "user_id")
    return j.select("user_id", F.bround(total(F.col("m")) / size / 5 * 100).cast("long").alias("technical_depth"), F.least(F.lit(100).cast("long"), 25 * F.col("talks")).alias("presentation"), F.bround(total(keyed) / F.greatest(F.lit(1), size) * 20).cast("long").alias("ai_knowledge"), F.least(F.lit(100).cast("long"), 10 * F.col("days")).alias("consistency"))


SOURCES_SQL = "src5 AS (SELECT user_id, ts FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'signup' UNION ALL SELECT o_custkey, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey % 720) FROM orders)"


@query("set_union_sources", f"WITH {SOURCES_SQL}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM src5 GROUP BY 1), g AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day) SELECT g.day, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 WHEN n <= 4 THEN 3 ELSE 4 END AS level FROM g LEFT JOIN d USING (day)")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Five kinds of activity as one bag, counted over 31 days with zeros, and the level of each day."""
    e = table(spark, sf, "events")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("o_orderkey") % 720 * 3600).alias("ts"))
    bag = orders
    for kind in ("view", "click", "purchase", "signup"):
        bag = bag.unionByName(e.filter(F.col("event_type") == kind).select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    d = bag.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(31).select(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")).alias("day"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(d, "day", "left").select("day", n.alias("n"), F.when(n <= 2, n).when(n <= 4, 3).otherwise(4).cast("int").alias("level"))
