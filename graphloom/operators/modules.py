"""Clusters as modules to learn from: hierarchy, stages, titles, matching of old to new, lookups by name, entries and roots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.code import candidate_roots, promoted_roots, score_roots
from graphloom.operators.graph import LAYER_SQL, file_components, layers, whole_graph
from graphloom.operators.neighborhood import BRANDS_SQL, bounded_depth, layers_of_condensation, module_edges
from graphloom.operators.rules import node_category
from graphloom.plans.projections import FILES_SQL, G1_SQL, files
from graphloom.plans.rounds import Round, written
from graphloom.registry import query
from graphloom.session import table

# Files of a module and of a topic at the least, the share of files with a layer for stages by layer, the
# least share of an old module that a new one must hold.
LEAST_FILES, LEAST_COVERAGE, LEAST_OVERLAP = 3, 0.40, 0.5

#: Ways to cut a module into topics, by name; a further one is a function of a path column.
TOPICS: dict[str, Callable[[Column], Column]] = {
    "folder": lambda p: F.regexp_replace(p, "/[^/]*$", ""),
    "top": lambda p: F.substring_index(p, "/", 1),
    "second_segment": lambda p: F.coalesce(F.get(F.split(p, "/"), 1), F.lit("")),
    "extension": lambda p: F.regexp_extract(p, r"(\.[^./]+)$", 1),
    "single": lambda p: F.lit("all"),
}


def hierarchy(f: DataFrame, topic: str = "second_segment", least: int = LEAST_FILES) -> DataFrame:
    """module, topic, files: members by topic; migrations stay out, topics that are too small go to 'other', small modules go."""
    kept = f.filter(node_category(F.col("path")) != "migration").withColumn("topic", TOPICS[topic](F.col("path")))
    size = kept.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("cluster")
    t = kept.groupBy("cluster", "topic").agg(F.count(F.lit(1)).alias("files")).join(size, "cluster", "left_semi")
    return t.groupBy(F.col("cluster").alias("module"), F.when(F.col("files") >= least, F.col("topic")).otherwise("other").alias("topic")).agg(F.sum("files").alias("files"))


@query("gr_module_hierarchy", f"WITH {FILES_SQL}, k AS (SELECT cluster, split_part(path, '/', 1) AS topic, count(*) AS n FROM files WHERE contains(path, '.config.') OR NOT contains(path, 'alembic/versions/') GROUP BY 1, 2), m AS (SELECT cluster FROM k GROUP BY 1 HAVING sum(n) >= 3) SELECT cluster AS module, CASE WHEN n >= 3 THEN topic ELSE 'other' END AS topic, CAST(sum(n) AS BIGINT) AS files FROM k WHERE cluster IN (SELECT cluster FROM m) GROUP BY 1, 2")
def hierarchy_query(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(files(spark, sf), "top")


def stages(f: DataFrame, layered: DataFrame, depth: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """module, stage: by the first layer of its files where enough files have one (none: stage null), else by dependencies.

    One row says which; both are small plans over modules.
    """
    j = f.join(layered, "id")
    share = F.broadcast(j.agg((F.count("layer") / F.count(F.lit(1)) >= least).alias("by_layer")))  # one row
    m = j.groupBy("cluster").agg(F.min("layer").alias("layer")).join(depth.withColumnRenamed("id", "cluster").withColumnRenamed("layer", "depth"), "cluster", "left")
    return m.crossJoin(share).select(F.col("cluster").alias("module"), F.when(F.col("by_layer"), F.col("layer")).otherwise(F.col("depth")).alias("stage"))


_HOPS_SQL = f"{LAYER_SQL}, {BRANDS_SQL.removeprefix(G1_SQL + ', ')}"


@query("gr_module_stages", f"""WITH RECURSIVE {_HOPS_SQL}, m AS (SELECT p_brand AS module, min(hop) AS layer FROM part JOIN scc ON scc.id = p_partkey LEFT JOIN bfs ON bfs.id = scc_id GROUP BY 1), c AS (SELECT count(hop) / count(*) >= .4 AS by_layer FROM scc LEFT JOIN bfs ON bfs.id = scc_id),
l AS (SELECT DISTINCT root AS id, 0 AS depth FROM bs UNION SELECT bd.dst, l.depth + 1 FROM l JOIN bd ON bd.src = l.id) SELECT module, CAST(CASE WHEN by_layer THEN layer ELSE (SELECT max(depth) FROM l JOIN bs ON root = l.id WHERE bs.id = module) END AS INTEGER) AS stage FROM m, c""")
def stages_query(spark: SparkSession, sf: str) -> DataFrame:
    f, (e, n, entries) = files(spark, sf), whole_graph(spark, sf)
    return stages(f, layers(e, n, entries, file_components(spark, sf)), layers_of_condensation(*module_edges(spark, sf)))


@query("gr_module_depth", f"WITH RECURSIVE {BRANDS_SQL}, cyc AS (SELECT id FROM bs WHERE root IN (SELECT root FROM bs GROUP BY 1 HAVING count(*) > 1) UNION SELECT be.dst FROM cyc JOIN be ON be.src = cyc.id), l AS (SELECT id, 0 AS depth FROM ms WHERE id NOT IN (SELECT id FROM cyc) UNION SELECT be.dst, l.depth + 1 FROM l JOIN be ON be.src = l.id AND be.dst NOT IN (SELECT id FROM cyc)) SELECT id, CAST(max(depth) AS INTEGER) AS depth FROM (SELECT * FROM l UNION ALL SELECT id, (SELECT count(*) FROM ms) - 1 FROM cyc) GROUP BY 1")
def module_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of modules by their dependencies, below their number whatever circles they form."""
    return bounded_depth(*module_edges(spark, sf))


@query("gr_title_disambiguation", "WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), d AS (SELECT p_brand, p_type, p_type AS title, count(*) OVER (PARTITION BY p_type) AS same FROM t) SELECT p_brand, p_type, CASE WHEN same > 1 THEN title || ' (' || p_brand || ')' ELSE title END AS title FROM d")
def titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title that several modules bear gets the module's own name behind it."""
    t = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    n = t.groupBy("p_type").agg(F.count(F.lit(1)).alias("same"))
    return t.join(n, "p_type").select("p_brand", "p_type", F.when(F.col("same") > 1, F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_type")).alias("title"))


@query("gr_unclustered", f"WITH {FILES_SQL}, c AS (SELECT cluster FROM files GROUP BY 1 HAVING count(*) >= 5) SELECT id, CASE WHEN cluster IN (SELECT cluster FROM c) THEN cluster ELSE 'Unclustered' END AS module FROM files")
def unclustered(spark: SparkSession, sf: str, least: int = 5) -> DataFrame:
    """Files that no module claims are one module of their own."""
    f = files(spark, sf).select("id", "cluster")
    big = f.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("cluster", F.lit(True).alias("claimed"))
    return f.join(big, "cluster", "left").select("id", F.when(F.col("claimed"), F.col("cluster")).otherwise("Unclustered").alias("module"))


def matched(old: DataFrame, new: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """old, new, overlap: one to one, by the share of the old module that the new one holds, largest first.

    old: id, old; new: id, new. Pairs that are the best left for both ends are taken together, round by round; with a
    total order of pairs that is what taking them one by one gives.
    """
    size = old.groupBy("old").agg(F.count(F.lit(1)).alias("size"))
    p = old.join(new, "id").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).join(size, "old").select("old", "new", (F.col("n") / F.col("size")).alias("overlap")).filter(F.col("overlap") >= least)
    left = Round(p, "pairs", n=F.count(F.lit(1)))
    done: list[DataFrame] = []
    key = F.struct((-F.col("overlap")).alias("o"), "old", "new")
    while left.metrics["n"]:
        both = left.table.withColumn("a", F.min(key).over(W.partitionBy("old"))).withColumn("b", F.min(key).over(W.partitionBy("new")))
        take = written(both.filter((F.col("a") == key) & (F.col("b") == key)).select("old", "new", "overlap"), "taken")
        done.append(take)
        rest = left.table.join(take.select("old"), "old", "left_anti").join(take.select("new"), "new", "left_anti")
        left = Round(rest.select("old", "new", "overlap"), "pairs", n=F.count(F.lit(1)))
    out = p.limit(0)
    for d in done:
        out = out.unionByName(d)
    return out


@query("join_greedy_match", f"WITH c AS (SELECT c_nationkey AS old, c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS new, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY old) AS overlap FROM c) SELECT old, new, round(overlap, 9) AS overlap FROM s WHERE overlap >= {LEAST_OVERLAP} AND old = new")
def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    new = F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0)
    m = matched(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("old")), c.select(F.col("c_custkey").alias("id"), new.alias("new")))
    return m.select("old", "new", F.round("overlap", 9).alias("overlap"))


TITLES_SQL = "t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN ' ' || upper(p_name) || ' ' WHEN 2 THEN split_part(p_name, ' ', 2) ELSE 'no such thing' END AS title FROM part)"


@query("join_alias_list", f"WITH {TITLES_SQL}, x AS (SELECT p_partkey AS id, unnest([lower(p_name), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS form FROM part), m AS (SELECT form, min(id) AS id FROM x GROUP BY 1) SELECT p_partkey, m.id AS found FROM t LEFT JOIN m ON form = lower(trim(title))")
def alias_list(spark: SparkSession, sf: str) -> DataFrame:
    """A title against every name and alias of every map, the least id of those that answer."""
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    x = p.select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.array(F.lower("p_name"), F.get(words, 0), F.get(words, 1)))).alias("form")).groupBy("form").agg(F.min("id").alias("found"))
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).when(k == 2, F.get(words, 1)).otherwise("no such thing")
    return p.select("p_partkey", F.lower(F.trim(title)).alias("form")).join(x, "form", "left").select("p_partkey", "found")


@query("gr_root_scores", f"WITH {FILES_SQL}, py AS (SELECT path, string_split(path, '/') AS p FROM files WHERE ends_with(path, '.py') AND NOT contains(path, '.config.')), im AS (SELECT DISTINCT array_to_string(p[2:], '/') AS rest FROM py), f AS (SELECT path, string_split(path, '/') AS p FROM files WHERE ends_with(path, '.py')), h AS (SELECT rest, p[1] AS root FROM f JOIN im ON array_to_string(p[2:], '/') = rest) SELECT root, count(DISTINCT rest) AS score, round(count(DISTINCT rest) / (SELECT count(*) FROM im), 9) AS share, count(DISTINCT rest) >= 3 AND count(DISTINCT rest) / (SELECT count(*) FROM im) >= .05 AS promoted FROM h GROUP BY 1")
def root_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How many open imports each root would answer, and which are promoted."""
    p = files(spark, sf).select("path")
    py = p.filter(F.endswith("path", F.lit(".py")))
    bare = F.regexp_replace(F.regexp_extract("path", "^[^/]+/(.*)$", 1), r"\.py$", "")
    spec = py.filter(~F.contains("path", F.lit(".config."))).select(F.replace(bare, F.lit("/"), F.lit(".")).alias("specifier")).distinct()
    i = spec.select(F.xxhash64("specifier").alias("id"), F.lit("main.py").alias("path"), "specifier", F.lit(None).cast("string").alias("name"))
    s = written(score_roots(i, py), "scores").join(candidate_roots(py), "root", "left_semi")
    good = promoted_roots(s).withColumn("promoted", F.lit(True))
    return s.join(good, "root", "left").select("root", "score", F.round("share", 9).alias("share"), F.coalesce("promoted", F.lit(False)).alias("promoted"))


# What configuration files say starts a program; patterns by the kind of file, each with the path as its first group.
ENTRIES = {
    "Dockerfile": (r"(?m)^(?:CMD|ENTRYPOINT)\b[^\n]*?([\w./-]+\.(?:py|js|ts))", r"(?m)^(?:CMD|ENTRYPOINT)\b[^\n]*?(?:uvicorn|gunicorn)\W+([\w.]+):\w+"),
    "Procfile": (r"(?m)^\w+:[^\n]*?([\w./-]+\.(?:py|js|ts))", r"(?m)^\w+:[^\n]*?(?:uvicorn|gunicorn)\s+([\w.]+):\w+"),
    "render.yaml": (r"startCommand:[^\n]*?([\w./-]+\.(?:py|js|ts))", r"startCommand:[^\n]*?(?:uvicorn|gunicorn)\s+([\w.]+):\w+"),
    "pyproject.toml": (r'(?m)^[\w-]+\s*=\s*"([\w.]+):\w+"',),
    "package.json": (r'"(?:main|module|bin)"\s*:\s*"([^"]+)"',),
    "index.html": (r'<script[^>]+src="/?([^"]+\.(?:ts|tsx|js|jsx))"',),
}
STARTS = r"(?m)^if __name__ == [\"']__main__[\"']|\bapp\.listen\(|\bcreateRoot\(|\bFastAPI\("


def entry_points(configs: DataFrame, sources: DataFrame) -> DataFrame:
    """path, source: files that a configuration names ('config'), else, where none does, those whose code starts a program ('pattern').

    configs and sources: path, content. A module path stands for its file; paths are taken from the configuration's folder.
    """
    name = F.substring_index("path", "/", -1)
    found = F.array().cast("array<string>")
    for kind, patterns in ENTRIES.items():
        found = F.when(name == kind, F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns)))).otherwise(found)
    c = configs.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.explode(found).alias("raw"))
    c = c.withColumn("bare", F.regexp_replace("raw", r"^\./", "")).withColumn("own", F.when(F.col("bare").rlike(r"\.(py|tsx?|jsx?)$"), F.array("bare")).otherwise(F.array(F.concat(F.replace("bare", F.lit("."), F.lit("/")), F.lit(".py")), F.concat(F.replace("bare", F.lit("."), F.lit("/")), F.lit("/__init__.py")))))
    named = c.select(F.explode(F.flatten(F.transform("own", lambda p: F.array(F.when(F.col("dir") == "", p).otherwise(F.concat_ws("/", "dir", p)), p)))).alias("path")).distinct().join(sources.select("path"), "path", "left_semi")
    named = written(named, "entries")
    some = F.broadcast(named.agg((F.count(F.lit(1)) > 0).alias("some")))  # one row
    fallback = sources.crossJoin(some).filter(~F.col("some") & F.col("content").rlike(STARTS)).select("path")
    return named.withColumn("source", F.lit("config")).unionByName(fallback.withColumn("source", F.lit("pattern")))


@query("gr_prior_migration", f"WITH {FILES_SQL}, p AS (SELECT id, CASE WHEN contains(path, '.config.') THEN 'config' WHEN contains(path, 'alembic/versions/') THEN 'migration' WHEN ends_with(path, '_pb2.py') THEN 'generated' WHEN ends_with(path, '/__init__.py') THEN 'barrel' ELSE 'source' END AS before, is_entry FROM files), n AS (SELECT *, CASE WHEN is_entry AND before = 'source' THEN 'entry' ELSE before END AS after FROM p) SELECT before, after, count(*) AS files, before <> after AS flipped, bool_or(is_entry AND before <> 'source') AS contradicted FROM n GROUP BY 1, 2")
def prior_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Source files that turn out to be entries become such; where another category says otherwise, it stays and is told."""
    before = node_category(F.col("path"))
    f = files(spark, sf).select("is_entry", before.alias("before"))
    f = f.withColumn("after", F.when(F.col("is_entry") & (F.col("before") == "source"), "entry").otherwise(F.col("before")))
    return f.groupBy("before", "after").agg(F.count(F.lit(1)).alias("files"), F.bool_or(F.col("before") != F.col("after")).alias("flipped"), F.bool_or(F.col("is_entry") & (F.col("before") != "source")).alias("contradicted"))
