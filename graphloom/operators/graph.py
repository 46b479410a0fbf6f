"""Graph operators over edges (src, dst): degrees, projections, neighbourhoods, layers, components and PageRank."""

from __future__ import annotations

import itertools
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.projections import G1_SQL, STEPS_SQL, WEIGHT_SQL, WEIGHTED_SQL, dense_edges, files, kind_weight, steps, weighted_edges
from graphloom.plans.rounds import Round, shared_dir, written
from graphloom.registry import query
from graphloom.sources.snapshots import SnapshotLog

DAMPING, MOST_ROUNDS, TOLERANCE = 0.85, 100, 1e-8


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, fan_in, fan_out; self-loops count in both, isolated nodes have 0."""
    both = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    d = both.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.join(d, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def undirected(edges: DataFrame) -> DataFrame:
    """Largest weight of each unordered pair, self-loops dropped."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"))


def by_source(edges: DataFrame) -> DataFrame:
    """The edges kept dealt by src for the rounds of a loop, so that only what joins them moves."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = DAMPING, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, seeds: DataFrame | None = None) -> DataFrame:
    """id, rank. Transition by weight (1 if edges have none); teleport and dangling mass go to the seeds, all nodes if none.

    Dangling mass goes where the teleport goes, so ranks are those without it, scaled to add up to 1. A round is one
    job: edges stay where they are dealt; ranks go out to them, inflows are added up before they move, and the write
    returns the change and the sum.
    """
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    share = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").filter("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))
    share = by_source(share)
    start = nodes if seeds is None or seeds.isEmpty() else seeds.join(nodes, "id", "left_semi").distinct()
    n = start.count()
    base = nodes.join(start.select("id", F.lit(1.0 / max(n, 1)).alias("v")), "id", "left").fillna(0.0, ["v"])
    state = Round(base.select("id", "v", F.col("v").alias("rank")), "rank", total=F.sum("rank"))
    for _ in range(rounds):
        flow = state.table.select(F.col("id").alias("src"), "rank").join(share, "src").select(F.col("dst").alias("id"), (F.col("rank") * F.col("p")).alias("flow"))
        own = state.table.select("id", F.lit(0.0).alias("flow"), "v", F.col("rank").alias("old"))
        new = own.unionByName(flow, allowMissingColumns=True).groupBy("id").agg(F.sum("flow").alias("inflow"), F.max("v").alias("v"), F.max("old").alias("old"))
        new = new.filter("v is not null").select("id", "v", "old", ((1 - damping) * F.col("v") + damping * F.col("inflow")).alias("rank"))
        done, state = state, Round(new, "rank", ["id", "v", "rank"], total=F.sum("rank"), change=F.sum(F.abs(F.col("rank") - F.col("old"))))
        done.delete()
        if (state.metrics["change"] or 0.0) < tolerance * (state.metrics["total"] or 1.0):
            break
    share.unpersist()
    return state.table.select("id", (F.col("rank") / F.lit(state.metrics["total"] or 1.0)).alias("rank"))


COMPACTED = 8  # tables of rounds that are read side by side before they become one


def walk(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, hop: the fewest steps along the edges from any start to each node that can be reached.

    Only the frontier moves; what was reached stays in the tables that its rounds wrote, a few of them at any time.
    """
    edges = by_source(edges.select("src", "dst"))
    spark = edges.sparkSession
    reached = [Round(start.select("id").distinct().withColumn("hop", F.lit(0)), "walk", n=F.count(F.lit(1)))]
    read = lambda rounds: spark.read.schema(rounds[0].table.schema).parquet(*(r.path for r in rounds))
    for hop in itertools.count(1):
        if not reached[-1].metrics["n"]:
            break
        step = reached[-1].table.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        reached.append(Round(step.join(read(reached), "id", "left_anti").withColumn("hop", F.lit(hop)), "walk", n=F.count(F.lit(1))))
        if len(reached) > COMPACTED:
            old, reached = reached[:-1], [Round(read(reached[:-1]), "walk"), reached[-1]]
            for r in old:
                r.delete()
    edges.unpersist()
    return read(reached)


def spread(edges: DataFrame, values: DataFrame) -> DataFrame:
    """id, label: the smallest label that reaches each node along the edges, by rounds in which only news move."""
    edges = by_source(edges.select("src", "dst"))
    state = Round(values.select("id", "label", F.lit(True).alias("new")), "spread", n=F.count(F.lit(1)))
    while state.metrics["n"]:
        news = state.table.filter("new").select(F.col("id").alias("src"), "label").join(edges, "src").select(F.col("dst").alias("id"), F.col("label").alias("arriving"))
        both = state.table.select("id", "label").unionByName(news, allowMissingColumns=True).groupBy("id").agg(F.min("label").alias("old"), F.min("arriving").alias("arriving")).filter("old is not null")
        better = F.col("arriving").isNotNull() & (F.col("arriving") < F.col("old"))
        done, state = state, Round(both.select("id", F.when(better, F.col("arriving")).otherwise(F.col("old")).alias("label"), better.alias("new")), "spread", n=F.count_if("new"))
        done.delete()
    edges.unpersist()
    return state.table.select("id", "label")


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


TRIM_SHARE, GIANT_SHARE = 100, 10


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, scc_id (smallest member), scc_size; no rows for no nodes.

    Nodes without edges in or out are components of their own; they go, round by round, as long as a round finds one in
    TRIM_SHARE. What is reached both forward and backward from the node with the most ways through it is a component,
    of a graph with a giant one mostly that; such pivots are taken as long as one finds a GIANT_SHARE of what is left.
    The rest, in many small components, is coloured: of the labels that reach a node the smallest is its colour, and
    all of one colour from which the colour's root is reached back are a component. Labels are hashes of ids, so that
    colours cut what is left into parts of all sizes, and edges between colours go: no component has two.
    """
    alive = Round(nodes.select("id").distinct(), "scc-alive", n=F.count(F.lit(1)))
    e = written(edges.filter("src <> dst").select("src", "dst").distinct(), "scc-edges")
    done: list[DataFrame] = []  # id, root
    left, pivots = alive.metrics["n"], True
    own_root = F.col("id").alias("root")
    while left:
        ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        degree = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        inner = F.coalesce((F.col("o") > 0) & (F.col("i") > 0), F.lit(False))
        ways = F.struct((F.col("o") * F.col("i")).alias("ways"), "id")
        mark = Round(alive.table.join(degree, "id", "left").select("id", inner.alias("inner"), F.when(inner, ways).alias("ways")), "scc-trim", ["id", "inner"], n=F.count_if("inner"), most=F.max("ways"))
        trimmed, left = left - mark.metrics["n"], mark.metrics["n"]
        done.append(mark.table.filter("not inner").select("id", own_root))
        alive = Round(mark.table.filter("inner").select("id"), "scc-alive")
        if not left:
            break
        e = written(among(e, alive.table), "scc-edges") if trimmed else e
        if trimmed * TRIM_SHARE > left:
            continue
        if pivots:
            pivot = nodes.sparkSession.createDataFrame([(mark.metrics["most"]["id"],)], nodes.select("id").schema)
            there, back = walk(e, pivot), walk(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivot)
            found = Round(there.join(back, "id", "left_semi").select("id"), "scc", n=F.count(F.lit(1)))
            pivots = found.metrics["n"] * GIANT_SHARE >= left
            done.append(found.table.select("id", F.lit(mark.metrics["most"]["id"]).alias("root")))
            left -= found.metrics["n"]
            alive = Round(alive.table.join(found.table, "id", "left_anti"), "scc-alive")
        else:
            c = spread(e, alive.table.select("id", F.xxhash64("id").alias("label"))).withColumnRenamed("label", "colour")
            alike = written(e.join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst"), "scc-edges")
            roots = c.filter(F.xxhash64("id") == F.col("colour")).select("id", "colour")
            back = walk(alike.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
            named = c.join(roots.select("colour", F.col("id").alias("root")), "colour")
            seen = Round(named.join(back.withColumn("hit", F.lit(True)), "id", "left").select("id", "root", F.col("hit").isNotNull().alias("hit")), "scc", left=F.count_if(~F.col("hit")))
            done.append(seen.table.filter("hit").select("id", "root"))
            alive, left, e = Round(seen.table.filter("not hit").select("id"), "scc-alive"), seen.metrics["left"], alike
        e = written(among(e, alive.table), "scc-edges") if left else e
    if not done:
        return nodes.select("id", F.col("id").alias("scc_id"), F.lit(0).cast("long").alias("scc_size")).limit(0)
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    named = all_.groupBy("root").agg(F.min("id").alias("scc_id"), F.count(F.lit(1)).alias("scc_size"))
    return all_.join(named, "root").select("id", "scc_id", "scc_size")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst: the distinct edges between components."""
    c = components.select("id", "scc_id")
    e = edges.join(c.toDF("src", "s"), "src").join(c.toDF("dst", "d"), "dst").filter("s <> d")
    return e.select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def layers(edges: DataFrame, nodes: DataFrame, entries: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """id, layer: steps between components from the nearest entry's; null where there is no way, or no entry.

    All members of an entry's component are on layer 0: a step inside a component costs nothing.
    """
    c = components if components is not None else written(strong_components(edges, nodes), "components")
    start = c.join(entries.select("id"), "id", "left_semi").select(F.col("scc_id").alias("id"))
    found = walk(condensed(edges, c), start).select(F.col("id").alias("scc_id"), F.col("hop").alias("layer"))
    return nodes.join(c.join(found, "scc_id").select("id", "layer"), "id", "left").select("id", "layer")


def reachable(layered: DataFrame, entries: DataFrame) -> DataFrame:
    """id, reachable: null for all where there are no entries."""
    some = F.broadcast(entries.agg((F.count(F.lit(1)) > 0).alias("some")))  # one row
    return layered.crossJoin(some).select("id", F.when(F.col("some"), F.col("layer").isNotNull()).alias("reachable"))


@query("gr_directed_graph", f"WITH {G1_SQL} SELECT src, dst FROM g1")
def directed_graph(spark: SparkSession, sf: str) -> DataFrame:
    return dense_edges(spark, sf)


@query("gr_weighted_graph", f"WITH {WEIGHTED_SQL} SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM wg")
def weighted_graph(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_edges(spark, sf)


@query("gr_undirected_graph", f"WITH {WEIGHTED_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(max(weight) AS DOUBLE) AS weight FROM wg WHERE src <> dst GROUP BY 1, 2")
def undirected_graph(spark: SparkSession, sf: str) -> DataFrame:
    return undirected(weighted_edges(spark, sf))


@query("gr_degree", f"WITH {G1_SQL} SELECT p_partkey AS id, (SELECT count(*) FROM g1 WHERE dst = p_partkey) AS fan_in, (SELECT count(*) FROM g1 WHERE src = p_partkey) AS fan_out FROM part")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return degrees(dense_edges(spark, sf), spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id")))


def rank_sql(edges: str, weight: str, damping: float, seed: str, rounds: int = 60) -> str:
    """PageRank with a fixed number of rounds as table prf; an edge without weight from each node to itself keeps every node in."""
    return f"""ids AS (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges}), tot AS (SELECT src, sum({weight}) AS t FROM {edges} GROUP BY 1), sd AS (SELECT id, ({seed}) AS s FROM ids), v AS (SELECT id, CASE WHEN s THEN 1.0 / (SELECT count(*) FROM sd WHERE s) ELSE 0 END AS v FROM sd),
e AS (SELECT src, dst, sum({weight} / t) AS p FROM {edges} JOIN tot USING (src) GROUP BY 1, 2 UNION ALL SELECT id, id, 0 FROM ids),
pr AS (SELECT id, CAST(v AS DOUBLE) AS r, 0 AS k FROM v UNION ALL SELECT q.id, (1 - {damping}) * v.v + {damping} * (q.flow + q.lost * v.v), q.k + 1 FROM (
  SELECT e.dst AS id, p.k, p.lost, sum(p.r * e.p) AS flow FROM (SELECT pr.id, pr.r, pr.k, coalesce(sum(CASE WHEN t IS NULL THEN pr.r END) OVER (), 0) AS lost FROM pr LEFT JOIN tot ON tot.src = pr.id WHERE k < {rounds}) p JOIN e ON e.src = p.id GROUP BY 1, 2, 3) q JOIN v ON v.id = q.id),
prf AS (SELECT id, r FROM pr WHERE k = {rounds})"""


ENTRY_SEED = "id IN (SELECT p_partkey FROM part WHERE p_size = 1)"


@query("gr_pagerank", f"WITH RECURSIVE {G1_SQL}, {rank_sql('g1', '1.0', 0.85, 'true')} SELECT id, round(r, 7) AS rank FROM prf")
def pagerank_query(spark: SparkSession, sf: str) -> DataFrame:
    e = written(dense_edges(spark, sf), "edges")
    return pagerank(e, nodes_of(e)).select("id", F.round("rank", 7).alias("rank"))


@query("gr_weighted_pagerank", f"WITH RECURSIVE {WEIGHTED_SQL}, {rank_sql('wg', 'weight', 0.65, ENTRY_SEED)} SELECT id, round(r, 7) AS rank FROM prf")
def weighted_pagerank_query(spark: SparkSession, sf: str) -> DataFrame:
    """Personalised by the entry files."""
    e = written(weighted_edges(spark, sf), "edges")
    return pagerank(e, nodes_of(e), 0.65, seeds=files(spark, sf).filter("is_entry").select("id")).select("id", F.round("rank", 7).alias("rank"))


def scc_sql(edges: str) -> str:
    """Components of a table's edges as table scc: the one around the node with the most edges by two walks, those that are left by their closure."""
    return f"""ids AS (SELECT p_partkey AS id FROM part), pv AS (SELECT src AS id FROM {edges} GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1), fw AS (SELECT id FROM pv UNION SELECT e.dst FROM fw JOIN {edges} e ON e.src = fw.id), bw AS (SELECT id FROM pv UNION SELECT e.src FROM bw JOIN {edges} e ON e.dst = bw.id),
big AS (SELECT id FROM fw INTERSECT SELECT id FROM bw), rest AS (SELECT src, dst FROM {edges} WHERE src NOT IN (SELECT id FROM big) AND dst NOT IN (SELECT id FROM big)), cl AS (SELECT src AS a, dst AS b FROM rest UNION SELECT cl.a, rest.dst FROM cl JOIN rest ON rest.src = cl.b),
scc AS (SELECT ids.id, CASE WHEN big.id IS NOT NULL THEN (SELECT min(id) FROM big) ELSE least(ids.id, coalesce(min(x.b), ids.id)) END AS scc_id FROM ids LEFT JOIN big ON big.id = ids.id LEFT JOIN (SELECT p.a, p.b FROM cl p JOIN cl q ON p.a = q.b AND p.b = q.a) x ON x.a = ids.id GROUP BY ids.id, big.id)"""


def condensed_sql(edges: str) -> str:
    return f"{scc_sql(edges)}, ce AS (SELECT DISTINCT a.scc_id AS src, b.scc_id AS dst FROM {edges} e JOIN scc a ON a.id = e.src JOIN scc b ON b.id = e.dst WHERE a.scc_id <> b.scc_id)"


def layer_sql(edges: str) -> str:
    return f"""{condensed_sql(edges)}, bfs(id, hop) USING KEY (id) AS (SELECT DISTINCT scc_id, 0 FROM scc JOIN part ON id = p_partkey WHERE p_size = 1 UNION SELECT ce.dst, min(bfs.hop) + 1 FROM bfs JOIN ce ON ce.src = bfs.id LEFT JOIN recurring.bfs AS r ON r.id = ce.dst WHERE r.id IS NULL GROUP BY ce.dst)"""


SCC_SQL, CONDENSED_SQL, LAYER_SQL = (f"{G1_SQL}, {f('g1')}" for f in (scc_sql, condensed_sql, layer_sql))


def whole_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All edges, all files and the entry files."""
    f = files(spark, sf)
    return written(dense_edges(spark, sf), "edges"), f.select("id"), f.filter("is_entry").select("id")


def file_components(spark: SparkSession, sf: str) -> DataFrame:
    """The strong components of the whole graph, written."""
    e, n, _ = whole_graph(spark, sf)
    return written(strong_components(e, n), "components")


@query("gr_scc", f"WITH RECURSIVE {SCC_SQL} SELECT id, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size FROM scc")
def scc_query(spark: SparkSession, sf: str) -> DataFrame:
    e, n, _ = whole_graph(spark, sf)
    return strong_components(e, n)


@query("gr_condensation", f"WITH RECURSIVE {CONDENSED_SQL} SELECT src, dst FROM ce")
def condensation(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the components of files; what lines of unknown parts connect is connected, as in the SQL."""
    e, n, _ = whole_graph(spark, sf)
    c = written(strong_components(e, n.unionByName(nodes_of(e))), "components")
    return condensed(e, c.join(n, "id", "left_semi"))


@query("gr_layers", f"WITH RECURSIVE {LAYER_SQL} SELECT scc.id, CAST(hop AS INTEGER) AS layer FROM scc LEFT JOIN bfs ON bfs.id = scc_id")
def layers_query(spark: SparkSession, sf: str) -> DataFrame:
    return layers(*whole_graph(spark, sf), file_components(spark, sf))


@query("gr_reachability", f"WITH RECURSIVE {LAYER_SQL} SELECT scc.id, CASE WHEN (SELECT count(*) FROM part WHERE p_size = 1) > 0 THEN hop IS NOT NULL END AS reachable FROM scc LEFT JOIN bfs ON bfs.id = scc_id")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    e, n, entries = whole_graph(spark, sf)
    return reachable(layers(e, n, entries, file_components(spark, sf)), entries)


@query("gr_structure_summary", f"""WITH RECURSIVE {LAYER_SQL}, z AS (SELECT scc_id, count(*) AS n FROM scc GROUP BY 1)
SELECT (SELECT count(*) FROM z) AS sccs, (SELECT count(*) FROM z WHERE n > 1) AS cycles, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM z WHERE n > 1) AS in_cycles, (SELECT max(n) FROM z) AS largest, (SELECT count(*) FROM scc LEFT JOIN bfs ON bfs.id = scc_id WHERE hop IS NULL) AS unreachable""")
def structure_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of a run: components, cycles, files in cycles, the largest, and files that no entry reaches."""
    e, n, entries = whole_graph(spark, sf)
    c = file_components(spark, sf)
    z = c.groupBy("scc_id").agg(F.count(F.lit(1)).alias("n"))
    counts = z.agg(F.count(F.lit(1)).alias("sccs"), F.count_if(F.col("n") > 1).alias("cycles"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_cycles"), F.max("n").alias("largest"))
    lost = layers(e, n, entries, c).agg(F.count_if(F.col("layer").isNull()).alias("unreachable"))
    return counts.crossJoin(F.broadcast(lost))  # one row each


@query("gr_structure_snapshot", f"WITH RECURSIVE {LAYER_SQL} SELECT scc.id, scc_id, CASE WHEN (SELECT count(*) FROM part WHERE p_size = 1) > 0 THEN hop IS NOT NULL END AS reachable FROM scc LEFT JOIN bfs ON bfs.id = scc_id")
def structure_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """What a run keeps of every file, committed as a snapshot of its own and read back from the log."""
    e, n, entries = whole_graph(spark, sf)
    c = file_components(spark, sf)
    log = SnapshotLog(spark, f"{shared_dir(spark)}/graphloom/structure-{uuid.uuid4().hex}")
    rows = c.select("id", "scc_id").join(reachable(layers(e, n, entries, c), entries), "id")
    return log.read(log.commit(rows))


#: A graph of many components beside the whole one: the edges of orders' lines of large quantities alone.
THIN = 47
THIN_SQL = STEPS_SQL + f", thin AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL AND l_quantity >= {THIN})"


def thin_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of large quantities, all files and the entry files."""
    f = files(spark, sf)
    return steps(spark, sf).filter((F.col("l_quantity") >= THIN) & F.col("dst").isNotNull()).select("src", "dst").distinct(), f.select("id"), f.filter("is_entry").select("id")


@query("gr_scc_thin", f"WITH RECURSIVE {THIN_SQL}, {scc_sql('thin')} SELECT id, scc_id, count(*) OVER (PARTITION BY scc_id) AS scc_size FROM scc")
def thin_scc(spark: SparkSession, sf: str) -> DataFrame:
    e, n, _ = thin_graph(spark, sf)
    return strong_components(e, n)


@query("gr_condensation_thin", f"WITH RECURSIVE {THIN_SQL}, {condensed_sql('thin')} SELECT src, dst FROM ce")
def thin_condensation(spark: SparkSession, sf: str) -> DataFrame:
    e, n, _ = thin_graph(spark, sf)
    return condensed(e, written(strong_components(e, n), "components"))


@query("gr_layers_thin", f"WITH RECURSIVE {THIN_SQL}, {layer_sql('thin')} SELECT scc.id, CAST(hop AS INTEGER) AS layer FROM scc LEFT JOIN bfs ON bfs.id = scc_id")
def thin_layers(spark: SparkSession, sf: str) -> DataFrame:
    return layers(*thin_graph(spark, sf))


@query("gr_connected", f"""WITH {G1_SQL}, nb AS (SELECT CASE WHEN src = 1 THEN dst ELSE src END AS id, src = 1 AS out FROM g1 WHERE (src = 1 OR dst = 1) AND src <> dst)
SELECT id, bool_or(out) AS is_import, bool_or(NOT out) AS is_importer FROM nb GROUP BY id""")
def connected(spark: SparkSession, sf: str, focus: int = 1) -> DataFrame:
    """Either endpoint of a node's edges, and in which directions; self-loops left out."""
    e = dense_edges(spark, sf).filter(((F.col("src") == focus) | (F.col("dst") == focus)) & (F.col("src") != F.col("dst")))
    out = F.col("src") == focus
    return e.groupBy(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("id")).agg(F.bool_or(out).alias("is_import"), F.bool_or(~out).alias("is_importer"))


@query("join_two_hop", f"""WITH {G1_SQL}, one AS (SELECT DISTINCT dst AS id FROM g1 WHERE src = 1), two AS (SELECT DISTINCT dst AS id FROM g1 WHERE src IN (SELECT id FROM one))
SELECT id, count(*) OVER () AS total FROM two WHERE id <> 1 AND id NOT IN (SELECT id FROM one) ORDER BY id LIMIT 200""")
def two_hop(spark: SparkSession, sf: str, focus: int = 1) -> DataFrame:
    """Second hop without the first and the focus: the first 200, and how many there are."""
    e = dense_edges(spark, sf)
    one = e.filter(F.col("src") == focus).select(F.col("dst").alias("id")).distinct()
    two = e.join(one.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    two = two.join(one, "id", "left_anti").filter(F.col("id") != focus)
    return two.crossJoin(F.broadcast(two.agg(F.count(F.lit(1)).alias("total")))).orderBy("id").limit(200)  # one row beside each


@query("gr_mutual_pairs", f"WITH {G1_SQL} SELECT a.src, a.dst FROM g1 a JOIN g1 b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = dense_edges(spark, sf)
    return e.filter("src < dst").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"])


@query("gr_module_dependencies", f"WITH {G1_SQL} SELECT a.p_brand AS from_module, b.p_brand AS to_module, count(*) AS n_edges FROM g1 JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey WHERE a.p_brand <> b.p_brand GROUP BY 1, 2")
def module_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    e = dense_edges(spark, sf).join(p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("from_module")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("to_module")), "dst")
    return e.filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("n_edges"))


@query("gr_entry_nodes", f"WITH {G1_SQL} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT dst FROM g1 WHERE src <> dst)")
def entry_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Files that no other file leads to."""
    e, n, _ = whole_graph(spark, sf)
    return n.join(e.filter("src <> dst").select(F.col("dst").alias("id")), "id", "left_anti")


@query("gr_neighbor_merge", f"""WITH {STEPS_SQL}, e AS (SELECT dst AS id, kind, {WEIGHT_SQL} AS w, CASE WHEN l_quantity > 40 THEN l_returnflag END AS cross_root, l_quantity, l_linenumber FROM steps WHERE src = 1 AND dst IS NOT NULL)
SELECT id, CAST(max(w) AS DOUBLE) AS weight, arg_min(kind, (-w, kind)) AS kind, min(cross_root) AS cross_root, count(*) AS n FROM e GROUP BY id""")
def neighbor_merge(spark: SparkSession, sf: str, focus: int = 1) -> DataFrame:
    """Parallel edges to a neighbour: the heaviest wins, ties by kind; the least known cross-root value is kept."""
    cross = F.when(F.col("l_quantity") > 40, F.col("l_returnflag"))
    e = steps(spark, sf).filter((F.col("src") == focus) & F.col("dst").isNotNull()).select(F.col("dst").alias("id"), "kind", kind_weight(F.col("kind")).alias("w"), cross.alias("cross_root"))
    return e.groupBy("id").agg(F.max("w").alias("weight"), F.min_by("kind", F.struct(-F.col("w"), "kind")).alias("kind"), F.min("cross_root").alias("cross_root"), F.count(F.lit(1)).alias("n"))


@query("gr_resolution_report", f"""WITH {WEIGHTED_SQL}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM wg WHERE src <> dst GROUP BY 1, 2)
SELECT p.p_brand AS cluster, round(CAST(sum(CASE WHEN p.p_brand = q.p_brand THEN w ELSE 0 END) AS DOUBLE), 6) AS internal_weight, (SELECT round(sqrt(2 * sum(w)), 6) FROM u) AS limit_weight FROM u JOIN part p ON a = p.p_partkey JOIN part q ON b = q.p_partkey GROUP BY 1""")
def resolution_report(spark: SparkSession, sf: str) -> DataFrame:
    """Weight inside each cluster against the resolution limit, the root of twice the whole weight."""
    u = undirected(weighted_edges(spark, sf))
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    j = u.join(p.toDF("a", "ca"), "a").join(p.toDF("b", "cb"), "b")
    inside = j.groupBy(F.col("ca").alias("cluster")).agg(F.round(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)), 6).alias("internal_weight"))
    return inside.crossJoin(F.broadcast(u.agg(F.round(F.sqrt(2 * F.sum("weight")), 6).alias("limit_weight"))))
