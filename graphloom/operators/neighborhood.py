"""What surrounds a file or an entry: neighbours with totals, blast radius, budgets, hops, reading order, drawings' groups."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import condensed, degrees, file_components, layers, strong_components, walk, whole_graph
from graphloom.operators.graph import LAYER_SQL as GRAPH_LAYER_SQL
from graphloom.plans.projections import FILES_SQL, G1_SQL, dense_edges, files
from graphloom.plans.rounds import Round, ordinal, written
from graphloom.registry import query
from graphloom.session import table

# Neighbours described in full, paths of the second hop, characters a token, folders a side, listed neighbours.
MOST_ENRICHED, MOST_SECOND_HOP, CHARS_A_TOKEN = 25, 200, 3.6
MOST_FOLDERS, MOST_LISTED, BYTES_A_TOKEN, MOST_SCOPED = 8, 100, 4.7, 1500
FOCUS = 1


def tokens(value: Column) -> Column:
    """How many tokens a value takes as compact JSON."""
    return F.floor(F.length(F.to_json(value)) / CHARS_A_TOKEN)


def sides(edges: DataFrame, focus: int) -> DataFrame:
    """id, side of the focus's neighbours; a file may be on both. A loop is an import, not an importer."""
    out = edges.filter(F.col("src") == focus).select(F.col("dst").alias("id"), F.lit("imports").alias("side"))
    into = edges.filter((F.col("dst") == focus) & (F.col("src") != focus)).select(F.col("src").alias("id"), F.lit("importers").alias("side"))
    return out.unionByName(into).distinct()


def neighbourhood(spark: SparkSession, sf: str, focus: int = FOCUS, most: int = MOST_ENRICHED) -> DataFrame:
    """side, path, rank, cluster, fan_in, crosses, enriched: the best ranked are described, of all others the path stays.

    crosses is null where either end has no cluster: it can't be told.
    """
    e, f = dense_edges(spark, sf), files(spark, sf)
    r = ordinal(degrees(e, f.select("id")).select("id", "fan_in"), [F.desc("fan_in")], ["id"], "rank")
    home = F.broadcast(f.filter(F.col("id") == focus).select(F.col("cluster").alias("home")))  # one row
    n = sides(e, focus).join(f, "id").join(r, "id").crossJoin(home)
    place = F.row_number().over(W.partitionBy("side").orderBy(F.asc_nulls_last("rank"), "path"))
    n = n.withColumn("enriched", place <= most)
    only = lambda c: F.when(F.col("enriched"), c)
    return n.select("side", "path", only(F.col("rank")).alias("rank"), only(F.col("cluster")).alias("cluster"), only(F.col("fan_in")).alias("fan_in"), only(F.col("cluster") != F.col("home")).alias("crosses"), "enriched", (F.col("cluster") == F.col("home")).alias("same"))


NEAR_SQL = f"""{G1_SQL}, {FILES_SQL}, fi AS (SELECT dst, count(*) AS n FROM g1 GROUP BY 1), r AS (SELECT id, path, cluster, coalesce(n, 0) AS fan_in, row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) AS rank FROM files LEFT JOIN fi ON dst = id),
sd AS (SELECT DISTINCT dst AS id, 'imports' AS side FROM g1 WHERE src = {FOCUS} UNION SELECT src, 'importers' FROM g1 WHERE dst = {FOCUS} AND src <> {FOCUS}),
nb AS (SELECT side, r.*, cluster = (SELECT cluster FROM files WHERE id = {FOCUS}) AS same, row_number() OVER (PARTITION BY side ORDER BY rank, path) <= {MOST_ENRICHED} AS enriched FROM sd JOIN r USING (id))"""


@query("gr_neighborhood", f"WITH {NEAR_SQL} SELECT side, path, CASE WHEN enriched THEN rank END AS rank, CASE WHEN enriched THEN cluster END AS cluster, CASE WHEN enriched THEN fan_in END AS fan_in, CASE WHEN enriched THEN NOT same END AS crosses, enriched FROM nb")
def neighbourhood_query(spark: SparkSession, sf: str) -> DataFrame:
    return neighbourhood(spark, sf).drop("same")


@query("gr_blast_radius", f"WITH {NEAR_SQL} SELECT side, count(*) AS total, count(*) FILTER (same) AS same_subsystem, count(*) FILTER (NOT same) AS other_subsystems, count(*) FILTER (same IS NULL) AS unknown FROM nb GROUP BY 1")
def blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    n = neighbourhood(spark, sf)
    return n.groupBy("side").agg(F.count(F.lit(1)).alias("total"), F.count_if("same").alias("same_subsystem"), F.count_if(~F.col("same")).alias("other_subsystems"), F.count_if(F.col("same").isNull()).alias("unknown"))


BUDGETS = (100, 1000, 4000, 20000)


@query("gr_budget", f"""WITH {NEAR_SQL}, hop AS (SELECT DISTINCT path FROM g1 JOIN sd ON g1.src = sd.id AND side = 'imports' JOIN files ON files.id = g1.dst WHERE g1.dst <> {FOCUS} AND g1.dst NOT IN (SELECT id FROM sd)),
s AS (SELECT (SELECT coalesce(sum(length(path) + 3), 0) FROM nb) AS paths, (SELECT coalesce(sum(length(cluster) + 30), 0) FROM nb WHERE enriched AND side = 'importers') AS a, (SELECT coalesce(sum(length(cluster) + 30), 0) FROM nb WHERE enriched AND side = 'imports') AS b, (SELECT coalesce(sum(length(path) + 3), 0) FROM (SELECT path FROM hop ORDER BY path LIMIT {MOST_SECOND_HOP})) AS h),
b AS (SELECT unnest([{', '.join(map(str, BUDGETS))}]) AS budget), t AS (SELECT budget, CAST(floor((paths + a + b + h) / 3.6) AS BIGINT) AS t0, CAST(floor((paths + a + b) / 3.6) AS BIGINT) AS t1, CAST(floor((paths + b) / 3.6) AS BIGINT) AS t2, CAST(floor(paths / 3.6) AS BIGINT) AS t3 FROM s, b)
SELECT budget, CASE WHEN t0 <= budget THEN 0 WHEN t1 <= budget THEN 1 WHEN t2 <= budget THEN 2 ELSE 3 END AS shed, CASE WHEN t0 <= budget THEN t0 WHEN t1 <= budget THEN t1 WHEN t2 <= budget THEN t2 ELSE t3 END AS tokens, greatest(t3 - budget, 0) AS shortfall FROM t""")
def budget(spark: SparkSession, sf: str, focus: int = FOCUS) -> DataFrame:
    """What is given up to meet a budget: the second hop, then the importers' metadata, then the imports'; paths never.

    shed is how many of the three went; shortfall is what the paths alone are over it. A neighbourhood's sizes are
    four numbers, and budgets a fixed list.
    """
    n = written(neighbourhood(spark, sf, focus), "neighbourhood")
    e, f = dense_edges(spark, sf), files(spark, sf).select("id", "path")
    first = sides(e, focus)
    hop = e.join(first.filter("side = 'imports'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    hop = hop.filter(F.col("id") != focus).join(first.select("id"), "id", "left_anti").join(f, "id").select("path").orderBy("path").limit(MOST_SECOND_HOP)
    size = lambda side: F.coalesce(F.sum(F.when(F.col("enriched") & (F.col("side") == side), F.length("cluster") + 30)), F.lit(0))
    s = n.agg(F.coalesce(F.sum(F.length("path") + 3), F.lit(0)).alias("paths"), size("importers").alias("a"), size("imports").alias("b")).crossJoin(hop.agg(F.coalesce(F.sum(F.length("path") + 3), F.lit(0)).alias("h")))  # one row each
    t = s.select(F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget"), *(F.floor(c / CHARS_A_TOKEN).alias(f"t{k}") for k, c in enumerate((F.col("paths") + F.col("a") + F.col("b") + F.col("h"), F.col("paths") + F.col("a") + F.col("b"), F.col("paths") + F.col("b"), F.col("paths")))))
    fits = [F.col(f"t{k}") <= F.col("budget") for k in range(3)]
    shed = F.when(fits[0], 0).when(fits[1], 1).when(fits[2], 2).otherwise(3)
    return t.select("budget", shed.alias("shed"), F.when(fits[0], F.col("t0")).when(fits[1], F.col("t1")).when(fits[2], F.col("t2")).otherwise(F.col("t3")).alias("tokens"), F.greatest(F.col("t3") - F.col("budget"), F.lit(0)).alias("shortfall"))


def hops(edges: DataFrame, focus: int, most: int, direction: str = "both") -> DataFrame:
    """id, hop: up to ``most`` steps from the focus, along the edges, against them, or both."""
    out, into = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"imports": out, "importedBy": into, "both": out.unionByName(into)}[direction]
    seen = edges.sparkSession.createDataFrame([(focus, 0)], "id long, hop int")
    for k in range(1, most + 1):
        next_ = steps.join(seen.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = written(seen.unionByName(next_.withColumn("hop", F.lit(k))), "hops")
    return seen


@query("gr_k_hop", f"""WITH RECURSIVE {G1_SQL}, {FILES_SQL}, st AS (SELECT src, dst FROM g1 UNION SELECT dst, src FROM g1), own AS (SELECT a.id AS src, b.id AS dst FROM st JOIN files a ON a.id = st.src JOIN files b ON b.id = st.dst WHERE a.cluster = b.cluster),
h AS (SELECT {FOCUS} AS id, 0 AS hop UNION SELECT own.dst, hop + 1 FROM h JOIN own ON own.src = h.id WHERE hop < 2), m AS (SELECT id, min(hop) AS hop FROM h GROUP BY 1), k AS (SELECT * FROM m ORDER BY hop, id LIMIT 60)
SELECT id, hop, (SELECT count(*) FROM m) AS total FROM k""")
def k_hop(spark: SparkSession, sf: str, focus: int = FOCUS, most: int = 60) -> DataFrame:
    """Two hops either way within the focus's cluster, the first by (hop, id) up to a cap, with the true total."""
    c = files(spark, sf).select("id", "cluster")
    e = dense_edges(spark, sf).join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")
    h = hops(e, focus, 2)
    total = F.broadcast(h.agg(F.count(F.lit(1)).alias("total")))  # one row
    return h.orderBy("hop", "id").limit(most).crossJoin(total)


@query("gr_connected_price", f"""WITH {G1_SQL}, {FILES_SQL}, nb AS (SELECT DISTINCT dst AS id FROM g1 WHERE src = {FOCUS} AND dst <> {FOCUS} UNION SELECT src FROM g1 WHERE dst = {FOCUS} AND src <> {FOCUS})
SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(round_even(sum(size_bytes) / 4.7, 0) AS BIGINT) AS naive_tokens, floor(sum(size_bytes) / 4.7 / sum(floor(length(path) / 3.6)) * 10) / 10 AS ratio FROM nb JOIN files USING (id)""")
def connected_price(spark: SparkSession, sf: str, focus: int = FOCUS) -> DataFrame:
    """What reading all connected files whole would cost, against naming them; the ratio is cut, not rounded."""
    n = sides(dense_edges(spark, sf), focus).filter(F.col("id") != focus).select("id").distinct().join(files(spark, sf), "id")
    size = F.sum("size_bytes")
    return n.agg(F.count(F.lit(1)).alias("files"), size.alias("bytes"), F.bround(size / BYTES_A_TOKEN).cast("long").alias("naive_tokens"), (F.floor(size / BYTES_A_TOKEN / F.sum(F.floor(F.length("path") / CHARS_A_TOKEN)) * 10) / 10).alias("ratio"))


@query("gr_unresolved_edges", "SELECT p.page_id, h.href, h.k AS position FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), 1) AS k FROM pages) h JOIN pages p USING (page_id) WHERE h.href NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)")
def unresolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links that lead to no known page, by page and place."""
    p = table(spark, sf, "pages")
    links = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("k", "href"))
    return links.join(p.select(F.col("url").alias("href")).distinct(), "href", "left_anti").select("page_id", "href", (F.col("k") + 1).cast("long").alias("position"))


@query("gr_artifact_scope", f"""WITH {G1_SQL}, {FILES_SQL}, fi AS (SELECT dst, count(*) AS n FROM g1 GROUP BY 1), k AS (SELECT id FROM files LEFT JOIN fi ON dst = id ORDER BY coalesce(n, 0) DESC, id LIMIT {MOST_SCOPED})
SELECT src, dst FROM g1 WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def artifact_scope(spark: SparkSession, sf: str, most: int = MOST_SCOPED) -> DataFrame:
    """The graph between the best ranked files; their number is the artifact's own limit."""
    e = dense_edges(spark, sf)
    kept = degrees(e, files(spark, sf).select("id")).orderBy(F.desc("fan_in"), "id").limit(most).select("id")
    return e.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@query("gr_region_groups", f"WITH {G1_SQL}, {FILES_SQL}, t AS (SELECT src AS id FROM g1 WHERE src <> dst UNION SELECT dst FROM g1 WHERE src <> dst) SELECT split_part(path, '/', 1) AS region, count(*) AS files, bool_or(t.id IS NOT NULL) AS connected FROM files LEFT JOIN t USING (id) GROUP BY 1")
def region_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Files by first folder, and whether any edge touches the group."""
    e = dense_edges(spark, sf).filter("src <> dst")
    t = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("touched", F.lit(True))
    f = files(spark, sf).join(t, "id", "left")
    return f.groupBy(F.substring_index("path", "/", 1).alias("region")).agg(F.count(F.lit(1)).alias("files"), F.bool_or(F.coalesce("touched", F.lit(False))).alias("connected"))


def longest_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, layer: the most steps from any node without edges in, of a graph without cycles.

    Each round passes on only layers that grew; a graph with a cycle would never end, so the number of nodes bounds it
    and an error says so.
    """
    most = nodes.count()
    state = Round(nodes.select("id", F.lit(0).alias("layer"), F.lit(True).alias("grew")), "longest", n=F.count(F.lit(1)))
    for _ in itertools.repeat(None, most + 1):
        if not state.metrics["n"]:
            return state.table.select("id", "layer")
        up = state.table.filter("grew").select(F.col("id").alias("src"), "layer").join(edges, "src").groupBy(F.col("dst").alias("id")).agg((F.max("layer") + 1).alias("new"))
        j = state.table.drop("grew").join(up, "id", "left")
        grew = F.coalesce(F.col("new") > F.col("layer"), F.lit(False))
        done, state = state, Round(j.select("id", F.when(grew, F.col("new")).otherwise(F.col("layer")).alias("layer"), grew.alias("grew")), "longest", n=F.count_if("grew"))
        done.delete()
    raise ValueError("the graph has a cycle: condense it first")


BRANDS_SQL = f"""{G1_SQL}, ms AS (SELECT DISTINCT p_brand AS id FROM part), be AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM g1 JOIN part a ON a.p_partkey = g1.src JOIN part b ON b.p_partkey = g1.dst WHERE a.p_brand <> b.p_brand), bc AS (SELECT src AS a, dst AS b FROM be UNION SELECT bc.a, be.dst FROM bc JOIN be ON be.src = bc.b),
bs AS (SELECT id, least(id, coalesce(min(b), id)) AS root FROM ms LEFT JOIN (SELECT p.a, p.b FROM bc p JOIN bc q ON p.a = q.b AND p.b = q.a) ON a = id GROUP BY id), bd AS (SELECT DISTINCT x.root AS src, y.root AS dst FROM be JOIN bs x ON x.id = src JOIN bs y ON y.id = dst WHERE x.root <> y.root)"""


def module_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """src, dst between modules, and the modules."""
    b = files(spark, sf).select("id", "cluster")
    e = dense_edges(spark, sf).join(b.toDF("src", "a"), "src").join(b.toDF("dst", "b"), "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return written(e, "modules"), b.select(F.col("cluster").alias("id")).distinct()


def layers_of_condensation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, layer: the most steps between components that lead to each node's own."""
    c = written(strong_components(edges, nodes), "components")
    found = longest_layers(written(condensed(edges, c), "condensed"), c.select(F.col("scc_id").alias("id")).distinct())
    return c.join(found.withColumnRenamed("id", "scc_id"), "scc_id").select("id", "layer")


def bounded_depth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, depth: one more than the deepest that leads here, never as much as there are nodes.

    Whatever a cycle leads to would rise without end, and has the most; no cycle leads to the others, so that theirs is
    the longest way to them.
    """
    most = nodes.count()
    c = written(strong_components(edges, nodes), "components")
    rising = walk(edges, c.filter("scc_size > 1").select("id")).select("id")
    calm = written(nodes.join(rising, "id", "left_anti"), "calm")
    found = longest_layers(written(edges.join(calm.withColumnRenamed("id", "src"), "src", "left_semi").join(calm.withColumnRenamed("id", "dst"), "dst", "left_semi"), "modules"), calm)
    return found.select("id", F.col("layer").alias("depth")).unionByName(rising.select("id", F.lit(most - 1).alias("depth")))


@query("gr_longest_layers", f"""WITH RECURSIVE {BRANDS_SQL}, l AS (SELECT DISTINCT root AS id, 0 AS layer FROM bs UNION SELECT bd.dst, l.layer + 1 FROM l JOIN bd ON bd.src = l.id) SELECT bs.id, CAST(max(layer) AS INTEGER) AS layer FROM bs JOIN l ON l.id = root GROUP BY 1""")
def longest_query(spark: SparkSession, sf: str) -> DataFrame:
    """Modules by the longest chain of dependencies that leads to them, circles condensed."""
    return layers_of_condensation(*module_edges(spark, sf))


ORDER_SQL = f"""{GRAPH_LAYER_SQL}, {FILES_SQL}, fi AS (SELECT dst, count(*) AS n FROM g1 GROUP BY 1), s AS (SELECT files.id, path, is_entry, coalesce(n, 0) AS score, hop AS layer FROM files LEFT JOIN fi ON dst = files.id JOIN scc ON scc.id = files.id LEFT JOIN bfs ON bfs.id = scc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY is_entry ORDER BY score DESC, path) AS place, (SELECT count(*) FROM part WHERE p_size = 1) AS exempt FROM s), sel AS (SELECT * FROM k WHERE is_entry OR place <= greatest(50 - exempt, 0))"""


@query("srt_reading_order", f"WITH RECURSIVE {ORDER_SQL} SELECT id, CAST(layer AS INTEGER) AS layer, row_number() OVER (ORDER BY coalesce(layer, (SELECT coalesce(max(layer) + 1, 0) FROM sel)), score DESC, path) AS position, layer IS NULL AS unreachable_but_central FROM sel")
def reading_order(spark: SparkSession, sf: str, top: int = 50) -> DataFrame:
    """The list to read: entries always, others by score for the places left; by layer and score, unreachable ones last."""
    e, n, entries = whole_graph(spark, sf)
    s = degrees(e, n).select("id", F.col("fan_in").alias("score")).join(layers(e, n, entries, file_components(spark, sf)), "id").join(files(spark, sf).select("id", "path", "is_entry"), "id")
    s = written(s, "scored")
    exempt = s.filter("is_entry")
    others = s.filter("not is_entry").orderBy(F.desc("score"), "path").limit(max(top - exempt.count(), 0))
    sel = written(exempt.unionByName(others), "selected")
    last = F.broadcast(sel.agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("last")))  # one row
    sel = sel.crossJoin(last).withColumn("key", F.coalesce("layer", "last"))
    return ordinal(sel, [F.asc("key"), F.desc("score")], ["path"], "position").select("id", "layer", "position", F.col("layer").isNull().alias("unreachable_but_central"))


@query("srt_directory_groups", f"""WITH {NEAR_SQL}, d AS (SELECT side, regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS files FROM nb GROUP BY 1, 2) SELECT side, dir, files, count(*) OVER (PARTITION BY side) AS folders, CAST(sum(files) OVER (PARTITION BY side) AS BIGINT) AS total FROM d QUALIFY row_number() OVER (PARTITION BY side ORDER BY files DESC, dir) <= {MOST_FOLDERS}""")
def directory_groups(spark: SparkSession, sf: str, most: int = MOST_FOLDERS) -> DataFrame:
    """Neighbours by folder, the largest of each side, with the true number of folders and files."""
    n = sides(dense_edges(spark, sf), FOCUS).join(files(spark, sf), "id")
    d = n.groupBy("side", F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    own = W.partitionBy("side")
    d = d.withColumn("k", F.row_number().over(own.orderBy(F.desc("files"), "dir"))).withColumn("folders", F.count(F.lit(1)).over(own)).withColumn("total", F.sum("files").over(own))
    return d.filter(F.col("k") <= most).drop("k")


@query("srt_neighbor_cap", f"WITH {NEAR_SQL} SELECT side, id, rank, count(*) OVER (PARTITION BY side) AS total FROM nb QUALIFY row_number() OVER (PARTITION BY side ORDER BY rank) <= {MOST_LISTED}")
def neighbor_cap(spark: SparkSession, sf: str, most: int = MOST_LISTED) -> DataFrame:
    """The best ranked neighbours of each side, with the true totals."""
    e = dense_edges(spark, sf)
    r = ordinal(degrees(e, files(spark, sf).select("id")).select("id", "fan_in"), [F.desc("fan_in")], ["id"], "rank").select("id", "rank")
    own = W.partitionBy("side")
    n = sides(e, FOCUS).join(r, "id").withColumn("k", F.row_number().over(own.orderBy("rank"))).withColumn("total", F.count(F.lit(1)).over(own))
    return n.filter(F.col("k") <= most).select("side", "id", "rank", "total")


@query("agg_neighbors_by_directory", f"WITH {NEAR_SQL} SELECT side, regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n, list_sort(list(path)) AS paths FROM nb GROUP BY 1, 2")
def neighbors_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    n = sides(dense_edges(spark, sf), FOCUS).join(files(spark, sf), "id")
    return n.groupBy("side", F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


@query("misc_context_graph", f"WITH {NEAR_SQL} SELECT id, max(CASE WHEN side = 'imports' THEN 1 ELSE 0 END) = 1 AS imported, max(CASE WHEN side = 'importers' THEN 1 ELSE 0 END) = 1 AS importer, count(*) AS edges FROM nb WHERE id <> {FOCUS} GROUP BY 1")
def context_graph(spark: SparkSession, sf: str) -> DataFrame:
    """One node for each neighbour, with an edge for each direction."""
    n = sides(dense_edges(spark, sf), FOCUS).filter(F.col("id") != FOCUS)
    return n.groupBy("id").agg(F.bool_or(F.col("side") == "imports").alias("imported"), F.bool_or(F.col("side") == "importers").alias("importer"), F.count(F.lit(1)).alias("edges"))


@query("misc_render_nodes", f"""WITH RECURSIVE {GRAPH_LAYER_SQL}, {FILES_SQL}, n AS (SELECT scc_id, cluster, count(*) AS n FROM scc JOIN files USING (id) GROUP BY 1, 2)
SELECT scc_id AS node, count(*) AS files, CAST(sum(nloc) AS BIGINT) AS nloc, bool_or(is_entry) AS is_entry, (SELECT arg_min(cluster, (-n.n, cluster)) FROM n WHERE n.scc_id = scc.scc_id) AS cluster FROM scc JOIN files USING (id) GROUP BY scc_id""")
def render_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each circle of imports drawn as one node: sums, any entry, and the cluster that most of its files have."""
    f = file_components(spark, sf).join(files(spark, sf), "id")
    c = f.groupBy("scc_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("nloc").alias("nloc"), F.bool_or("is_entry").alias("is_entry"))
    return c.groupBy(F.col("scc_id").alias("node")).agg(F.sum("n").alias("files"), F.sum("nloc").alias("nloc"), F.bool_or("is_entry").alias("is_entry"), F.min_by("cluster", F.struct((-F.col("n")).alias("n"), "cluster")).alias("cluster"))


@query("misc_layer_histogram", f"WITH RECURSIVE {GRAPH_LAYER_SQL} SELECT CAST(hop AS INTEGER) AS layer, count(*) AS files FROM scc LEFT JOIN bfs ON bfs.id = scc_id GROUP BY 1")
def layer_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return layers(*whole_graph(spark, sf), file_components(spark, sf)).groupBy("layer").agg(F.count(F.lit(1)).alias("files"))


@query("misc_layer_columns", f"WITH RECURSIVE {GRAPH_LAYER_SQL}, fi AS (SELECT dst, count(*) AS n FROM g1 GROUP BY 1) SELECT CAST(hop AS INTEGER) AS layer, list(scc.id ORDER BY coalesce(n, 0) DESC, scc.id)[1:20] AS members, count(*) AS total FROM scc LEFT JOIN bfs ON bfs.id = scc_id LEFT JOIN fi ON fi.dst = scc.id GROUP BY 1")
def layer_columns(spark: SparkSession, sf: str, most: int = 20) -> DataFrame:
    """A column for each layer, unreachable files in one of their own: the best ranked members and how many there are."""
    e, n, entries = whole_graph(spark, sf)
    j = layers(e, n, entries, file_components(spark, sf)).join(degrees(e, n), "id")
    own = W.partitionBy("layer").orderBy(F.desc("fan_in"), "id")
    top = j.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= most).groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("m"))
    total = j.groupBy("layer").agg(F.count(F.lit(1)).alias("total"))
    return total.alias("t").join(top.alias("m"), F.col("t.layer").eqNullSafe(F.col("m.layer"))).select("t.layer", F.transform("m.m", lambda x: x["id"]).alias("members"), "t.total")
