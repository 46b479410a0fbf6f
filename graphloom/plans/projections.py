"""Projections of the synthetic tables onto the engine's inputs, each with its SQL as a common table expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import table

KIND_SQL = """CASE WHEN l_discount >= 0.1 THEN 'unresolvable_binding' WHEN l_returnflag || l_linestatus = 'AF' THEN 'inherits' WHEN l_returnflag || l_linestatus = 'AO' THEN 'calls' WHEN l_returnflag || l_linestatus = 'NF' THEN 'heavy_use' WHEN l_returnflag || l_linestatus = 'NO' THEN 'light_use' WHEN l_returnflag || l_linestatus = 'RF' THEN 'type_only' WHEN l_linenumber % 2 = 0 THEN 'reexport' ELSE 'test_edge' END"""
STEPS_SQL = """steps AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_returnflag, l_linestatus, l_quantity, l_linenumber, """ + f"{KIND_SQL} AS kind FROM lineitem)"
G1_SQL = STEPS_SQL + ", g1 AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL)"
#: Weights of edge kinds; any other kind weighs nothing.
KIND_WEIGHTS = {"inherits": 1.0, "calls": 0.8, "heavy_use": 0.8, "light_use": 0.4, "type_only": 0.25, "reexport": 0.15, "test_edge": 0.05, "unresolvable_binding": 0.7}
WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_WEIGHTS.items()) + " ELSE 0 END"
WEIGHTED_SQL = STEPS_SQL + f""", wg AS (SELECT src, dst, CAST(max({WEIGHT_SQL}) AS DOUBLE) AS weight FROM steps WHERE dst IS NOT NULL GROUP BY src, dst)"""
#: Parts as source files: a path of five parts, and measures that follow from the size.
FILES_SQL = """files AS (SELECT p_partkey AS id, lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' || replace(p_name, ' ', '/') || '/' ||
  CASE p_size % 12 WHEN 0 THEN 'test_' WHEN 1 THEN 'vite.config.' WHEN 2 THEN 'alembic/versions/' ELSE '' END || 'part' || p_partkey || CASE WHEN p_size % 12 = 3 THEN '_pb2' WHEN p_size % 12 = 4 THEN '/__init__' ELSE '' END ||
  CASE WHEN p_size % 12 IN (3, 4) THEN '.py' ELSE ['.py', '.ts', '.tsx', '.js', '.jsx', '.md'][p_partkey % 6 + 1] END AS path,
  p_size * 20 AS nloc, p_size * 740 AS size_bytes, p_brand AS cluster, p_size = 1 AS is_entry FROM part)"""
PATH_SQL = """paths AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path, c_acctbal AS value, c_custkey, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HIST_SQL = """hist AS (SELECT o_custkey AS id, count(*) AS commits, count(DISTINCT o_orderpriority) AS authors, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey)"""

#: The same of parts: a commit is an order, an author a supplier.
FILE_HIST_SQL = """fhist AS (SELECT p_partkey AS id, coalesce(c, 0) AS commits, coalesce(a, 0) AS authors, CAST(floor((epoch(TIMESTAMP '2003-01-01') - epoch(t)) / 86400) AS BIGINT) AS days FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS c, count(DISTINCT l_suppkey) AS a, max(l_shipdate) AS t FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def line_kind() -> Column:
    """The kind of edge that an order's line stands for."""
    flags = F.concat("l_returnflag", "l_linestatus")
    kind = F.when(F.col("l_discount") >= 0.1, "unresolvable_binding")
    for f, k in (("AF", "inherits"), ("AO", "calls"), ("NF", "heavy_use"), ("NO", "light_use"), ("RF", "type_only")):
        kind = kind.when(flags == f, k)
    return kind.when(F.col("l_linenumber") % 2 == 0, "reexport").otherwise("test_edge")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to next part of an order, with the kind that the line's flags stand for."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", line_kind().alias("kind"))


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to next part of an order, distinct."""
    return steps(spark, sf_dir).filter("dst is not null").select("src", "dst").distinct()


def kind_weight(kind: Column) -> Column:
    """Weight of an edge kind, 0 where unknown."""
    known = F.create_map(*(F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, kind), F.lit(0.0))


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges collapse to their largest weight."""
    e = steps(spark, sf_dir).filter("dst is not null").withColumn("weight", kind_weight(F.col("kind")))
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files: id, path, nloc, size_bytes, cluster, is_entry."""
    size, kind = F.col("p_size"), F.col("p_size") % 12
    prefix = F.when(kind == 0, "test_").when(kind == 1, "vite.config.").when(kind == 2, "alembic/versions/").otherwise("")
    suffix = F.when(kind == 3, "_pb2").when(kind == 4, "/__init__").otherwise("")
    extension = F.when(kind.isin(3, 4), ".py").otherwise(F.get(F.array(*map(F.lit, (".py", ".ts", ".tsx", ".js", ".jsx", ".md"))), (F.col("p_partkey") % 6).cast("int")))
    name = F.concat(prefix, F.lit("part"), F.col("p_partkey").cast("string"), suffix, extension)
    path = F.concat_ws("/", F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("/")), name)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), (size * 20).alias("nloc"), (size * 740).alias("size_bytes"), F.col("p_brand").alias("cluster"), (size == 1).alias("is_entry"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/nation/segment/customer with the account balance as measure."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), F.col("c_acctbal").alias("value"), "c_custkey", F.col("c_mktsegment").alias("segment"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("o_orderpriority").alias("authors"), F.max("o_orderdate").alias("last_at"))


def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, commits, authors, days since the last commit; of files without any 0, 0 and null."""
    line = table(spark, sf_dir, "lineitem")
    pairs = lambda c: line.select("l_partkey", c).distinct().groupBy("l_partkey").agg(F.count(c).alias(c))
    last = line.groupBy("l_partkey").agg(F.max("l_shipdate").alias("t"))
    h = last.join(pairs("l_orderkey"), "l_partkey").join(pairs("l_suppkey"), "l_partkey")
    j = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(h.withColumnRenamed("l_partkey", "id"), "id", "left")
    days = F.floor((F.unix_micros(F.to_timestamp(F.lit("2003-01-01"))) - F.unix_micros(F.col("t").cast("timestamp"))) / 86_400_000_000)
    return j.select("id", F.coalesce("l_orderkey", F.lit(0)).alias("commits"), F.coalesce("l_suppkey", F.lit(0)).alias("authors"), days.alias("days"))
