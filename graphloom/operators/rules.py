"""Rules over names, paths, reviews and progress, as JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.projections import FILES_SQL, PATH_SQL, files, paths
from graphloom.registry import query
from graphloom.session import table

# Suffixes in the order that they are tried, languages by extension, test folders, priors of nodes.
SUFFIXES = ("ations", "ation", "ments", "ment", "ings", "ing", "ions", "ion", "ers", "er", "ed", "es", "s")
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript"}
TEST_FOLDERS = ("test", "tests", "__tests__", "__mocks__", "spec", "specs")
TEST_NAME = r"^test[_.\-]|[_.\-]tests?[_.\-]|[_.\-]tests?\.|\.spec\.|^conftest\.py$"
PRIORS = {"entry": 1.4, "source": 1.0, "barrel": 0.4, "config": 0.2, "migration": 0.15, "generated": 0.05}
PASS = 70
LAST_INTERVAL = 4


def stem(word: Column) -> Column:
    """The first suffix that leaves four letters goes, then a final e and a doubled last letter of five letters or more."""
    w = F.lower(word)
    cut = reduce(lambda rest, s: F.when(F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= 4), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(rest), reversed(SUFFIXES), w)
    bare = F.regexp_replace(cut, "^(.{4,})e$", "$1")
    return F.regexp_replace(bare, r"^(.{3,}(.))\2$", "$1")


STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 4 THEN left(w, length(w) - {len(s)})" for s in SUFFIXES) + " ELSE w END"


@query("str_stem", f"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), b AS (SELECT w, {STEM_SQL} AS c FROM a), d AS (SELECT w, CASE WHEN ends_with(c, 'e') AND length(c) > 4 THEN left(c, length(c) - 1) ELSE c END AS c FROM b)
SELECT w, CASE WHEN length(c) > 4 AND right(c, 1) = left(right(c, 2), 1) THEN left(c, length(c) - 1) ELSE c END AS stem FROM d""")
def stems(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", stem(F.col("w")).alias("stem"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By extension, in any case; null where there is none or it is unknown."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_test_file(path: Column) -> Column:
    folders = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    return F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, TEST_FOLDERS))) | basename(F.lower(path)).rlike(TEST_NAME)


def node_category(path: Column) -> Column:
    """config, then migration, generated, barrel, source: the first that holds."""
    name = basename(path)
    return F.when(name.rlike(r"\.config\.") | name.isin("alembic.ini", "setup.py"), "config").when(F.contains(path, F.lit("alembic/versions/")), "migration").when(F.endswith(name, F.lit("_pb2.py")) | name.isin("package-lock.json", "yarn.lock", "poetry.lock"), "generated").when(name.rlike(r"^(__init__\.py|index\.[jt]sx?)$"), "barrel").otherwise("source")


@query("src_language", f"WITH {FILES_SQL} SELECT id, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' END AS language FROM files")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("id", language(F.col("path")).alias("language"))


@query("flt_test_file", f"WITH {FILES_SQL}, n AS (SELECT id, CASE id % 4 WHEN 0 THEN 'tests/' || path WHEN 1 THEN replace(path, 'part', 'latest_part') WHEN 2 THEN replace(path, '.ts', '.spec.ts') ELSE path END AS path FROM files) SELECT id, starts_with(path, 'tests/') OR regexp_matches(path, '/test_[^/]*$') OR contains(path, '.spec.') AS is_test FROM n")
def test_files(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("id") % 4, F.col("path")
    path = F.when(k == 0, F.concat(F.lit("tests/"), p)).when(k == 1, F.replace(p, F.lit("part"), F.lit("latest_part"))).when(k == 2, F.replace(p, F.lit(".ts"), F.lit(".spec.ts"))).otherwise(p)
    return files(spark, sf).select("id", is_test_file(path).alias("is_test"))


@query("gr_node_prior", f"WITH {FILES_SQL}, c AS (SELECT id, is_entry, CASE WHEN contains(path, '.config.') THEN 'config' WHEN contains(path, 'alembic/versions/') THEN 'migration' WHEN ends_with(path, '_pb2.py') THEN 'generated' WHEN ends_with(path, '/__init__.py') THEN 'barrel' WHEN is_entry THEN 'entry' ELSE 'source' END AS category FROM files) SELECT id, category, CAST(CASE category WHEN 'entry' THEN 1.4 WHEN 'config' THEN .2 WHEN 'migration' THEN .15 WHEN 'generated' THEN .05 WHEN 'barrel' THEN .4 ELSE 1 END AS DOUBLE) AS prior FROM c")
def node_prior(spark: SparkSession, sf: str) -> DataFrame:
    """A file's category and what it is worth before any ranking; a source file that is an entry is worth most."""
    known = F.create_map(*(F.lit(x) for kv in PRIORS.items() for x in kv))
    own = node_category(F.col("path"))
    return files(spark, sf).select("id", F.when((own == "source") & F.col("is_entry"), "entry").otherwise(own).alias("category")).withColumn("prior", known[F.col("category")])


@query("str_parent_directory", f"WITH {PATH_SQL} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, split_part(path, '/', 2) AS second FROM paths")
def parents(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("path", "/")
    return paths(spark, sf).select("path", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"), F.coalesce(F.get(parts, 1), F.lit("")).alias("second"))


@query("str_url_parts", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1) AS first FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+/([^/?#]+)", 1).alias("first"))


@query("math_level", "SELECT user_id, CAST(count(*) * 50 // 500 + 1 AS BIGINT) AS level FROM events GROUP BY 1")
def levels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg((F.floor(F.count(F.lit(1)) * 50 / 500) + 1).alias("level"))


@query("math_xp", "SELECT event_id, CASE WHEN event_id % 101 >= 70 THEN CAST(round_even(150 + 250 * (event_id % 101 - 70) / 100.0, 0) AS BIGINT) ELSE 0 END AS xp FROM events")
def xp(spark: SparkSession, sf: str) -> DataFrame:
    """150 and up to 75 more for a score from 70; nothing below."""
    score = F.col("event_id") % 101
    return table(spark, sf, "events").select("event_id", F.when(score >= PASS, F.bround(150 + 250 * (score - PASS) / 100).cast("long")).otherwise(F.lit(0).cast("long")).alias("xp"))


@query("stm_review_fold", """WITH f AS (SELECT *, count(*) FILTER (event_id % 101 < 70) OVER w AS fails FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, least(4, count(*) FILTER (event_id % 101 >= 70) OVER (PARTITION BY user_id, fails ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS step FROM f""")
def review_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Place in the list of intervals after each review: a pass goes one on, a failure to the start."""
    passed = F.col("event_id") % 101 >= PASS
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", passed.alias("passed")).withColumn("fails", F.count_if(~F.col("passed")).over(w))
    own = W.partitionBy("user_id", "fails").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", F.least(F.lit(LAST_INTERVAL).cast("long"), F.count_if("passed").over(own)).alias("step"))


@query("agg_weighted_accuracy", """WITH a AS (SELECT user_id, event_type, avg(CASE WHEN event_id % 101 >= 70 THEN 1.0 ELSE 0.0 END) AS accuracy, CASE event_type WHEN 'purchase' THEN .5 WHEN 'click' THEN .3 ELSE .2 END AS weight FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS types, round(CAST(sum(accuracy * weight) / sum(weight) AS DOUBLE), 6) AS overall FROM a GROUP BY 1""")
def weighted_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by type, weighted over the types that a user has."""
    weight = F.when(F.col("event_type") == "purchase", 0.5).when(F.col("event_type") == "click", 0.3).otherwise(0.2)
    a = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg(F.when(F.col("event_id") % 101 >= PASS, 1.0).otherwise(0.0)).alias("accuracy")).withColumn("weight", weight)
    return a.groupBy("user_id").agg(F.count(F.lit(1)).alias("types"), F.round(F.sum(F.col("accuracy") * F.col("weight")) / F.sum("weight"), 6).alias("overall"))


@query("agg_latest_mean", "WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS kinds, round(avg(value), 6) AS blended FROM l GROUP BY 1")
def latest_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the latest value of each kind."""
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("kinds"), F.round(F.avg("value"), 6).alias("blended"))


@query("agg_progress", "WITH p AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1) SELECT o_custkey, CAST(round_even(100.0 * done / total, 0) AS BIGINT) AS percent, CASE WHEN done = 0 THEN 'not_started' WHEN done = total THEN 'completed' ELSE 'in_progress' END AS state FROM p")
def progress(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return p.select("o_custkey", F.bround(100 * F.col("done") / F.col("total")).cast("long").alias("percent"), F.when(F.col("done") == 0, "not_started").when(F.col("done") == F.col("total"), "completed").otherwise("in_progress").alias("state"))


@query("misc_parent_complete", "SELECT l_orderkey, bool_and(l_linestatus = 'F') AS complete FROM lineitem GROUP BY 1")
def parent_complete(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("complete"))


@query("misc_question_count", "SELECT p_partkey, CASE WHEN p_size <= 3 THEN 15 WHEN p_size <= 6 THEN 20 ELSE 25 END AS questions FROM part")
def question_count(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.when(n <= 3, 15).when(n <= 6, 20).otherwise(25).alias("questions"))


@query("join_previous_comparable", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def previous_comparable(spark: SparkSession, sf: str) -> DataFrame:
    """As-of: the latest earlier row of the same keys, without a join."""
    w = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


@query("win_round_robin", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_brand, p_partkey FROM r ORDER BY turn, p_brand LIMIT 6")
def round_robin(spark: SparkSession, sf: str, cap: int = 6) -> DataFrame:
    """One of each group in turn, up to a cap; no group can give more than the cap."""
    r = table(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("turn"))
    return r.filter(F.col("turn") <= cap).orderBy("turn", "p_brand").limit(cap).select("p_brand", "p_partkey")


@query("st_partition_agreement", "WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), g AS (SELECT a, max(n) AS most, sum(n) AS size FROM c GROUP BY 1 HAVING sum(n) > 1) SELECT round(CAST(sum(most) / sum(size) AS DOUBLE), 9) AS agreement FROM g")
def partition_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the members of each group with others that lie in its most common group of another partition."""
    c = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("c_mktsegment").agg(F.max("n").alias("most"), F.sum("n").alias("size")).filter("size > 1")
    return g.agg(F.round(F.sum("most") / F.sum("size"), 9).alias("agreement"))
