"""Quiz cards from a module's facts: templates, choices by similarity and rotation, quality, variety, grading.

A module is a cluster of files. Cards of all modules are made at once; a template is a plan over facts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import STOPWORDS, graded_form, name_tokens, shortest_distinct, similarity
from graphloom.operators.graph import THIN_SQL, degrees, file_components, layer_sql, layers, thin_graph, whole_graph
from graphloom.plans.projections import FILES_SQL, G1_SQL, dense_edges, files
from graphloom.plans.rounds import ordinal, written
from graphloom.registry import query

# The largest lead of an answer's similarity, wrong options of a card and the fewest, cards of a module.
MOST_LEAD, OPTIONS, LEAST_OPTIONS, MOST_CARDS = 0.34, 3, 2, 6
WINDOW, BLOCK = 4 * OPTIONS, 4096  # the most similar files that options are taken from; subjects that meet their module's files in one task


def module_facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files with module, fan-in and rank, and the edges within modules."""
    f, e = files(spark, sf), dense_edges(spark, sf)
    d = ordinal(degrees(e, f.select("id")).select("id", "fan_in"), [F.desc("fan_in")], ["id"], "rank")
    f = written(f.select("id", "path", F.col("cluster").alias("module")).join(d.select("id", "fan_in", "rank"), "id"), "facts")
    own = f.select("id", "path", "module")
    inner = e.filter("src <> dst").join(own.toDF("src", "a", "m"), "src").join(own.toDF("dst", "b", "n"), "dst").filter("m = n").select("m", "a", "b")
    return f, written(inner, "inner")


def windows(asked: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
    """module, subject, window: of each subject the first files of the pool by common names with the answer and by path, without what is barred.

    A name that only one file bears tells nothing, as an answer isn't among its own card's options. Subjects whose
    answers have the same names look at one order of the pool.
    """
    pool = pool.sort_values("path", ignore_index=True)
    paths, tokens = pool["path"].to_numpy(), [list(t) for t in pool["tokens"]]
    often = Counter(t for own in tokens for t in own)
    code = {t: k for k, t in enumerate(t for t, n in often.items() if n > 1)}
    reduced = lambda own: tuple(sorted(code[t] for t in own if t in code))
    kinds: dict[tuple[int, ...], int] = {}
    kind = np.array([kinds.setdefault(reduced(own), len(kinds)) for own in tokens], np.int64)
    by_token: dict[int, list[int]] = defaultdict(list)
    for names, k in kinds.items():
        for t in names:
            by_token[t].append(k)
    listed = {t: np.array(k) for t, k in by_token.items()}
    rank, equal, out = np.arange(len(paths)), len(set(paths)) < len(paths), []
    for names, rows in asked.assign(names=[reduced(t) for t in asked["tokens"]]).groupby("names"):
        alike = np.zeros(len(kinds), np.int64)
        for t in names:
            alike[listed[t]] += 1
        key = (len(names) - alike)[kind] * len(paths) + rank
        barred = [{r.subject, r.answer, *(r.barred if r.barred is not None else ())} for r in rows.itertuples()]
        most = min(len(paths), WINDOW + max(map(len, barred)))
        first = np.sort(np.partition(key, most - 1)[:most]) % len(paths) if most else key
        if equal:  # any number of rows may be barred
            first = np.sort(key) % len(paths)
        for r, no in zip(rows.itertuples(), barred, strict=True):
            out.append((r.module, r.subject, list(islice((p for p in map(paths.__getitem__, first) if p not in no), WINDOW))))
    return pd.DataFrame(out, columns=["module", "subject", "window"])


def distractors(subjects: DataFrame, pool: DataFrame, taken: DataFrame) -> DataFrame:
    """module, subject, wrong: up to three files that are no answer, from those most alike to it, by a turn that the subject's checksum sets.

    subjects: module, subject, answer; pool: module, path; taken: module, subject, path of what would be right too. The
    candidates of a card are the files of its module; the window of the most similar ones is four times the options.
    Subjects of a module meet its files in blocks, each in a task of its own that holds both and no pair of them.
    """
    barred = taken.groupBy("module", "subject").agg(F.collect_set("path").alias("barred"))
    blocks = subjects.groupBy("module").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    s = subjects.join(barred, ["module", "subject"], "left").join(blocks, "module").withColumn("block", F.pmod(F.xxhash64("answer"), "blocks"))
    s = s.select("module", "block", "subject", "answer", "barred", name_tokens(F.col("answer")).alias("tokens"))
    p = pool.join(blocks, "module").select("module", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "path", name_tokens(F.col("path")).alias("tokens"))
    w = s.groupBy("module", "block").cogroup(p.groupBy("module", "block")).applyInPandas(windows, "module string, subject string, window array<string>").filter(F.size("window") > 0)
    n = F.size("window")
    turn = F.pmod(F.crc32(F.encode("subject", "UTF-8")), n)
    wrong = F.transform(F.sequence(F.lit(0), F.least(F.lit(OPTIONS), n) - 1), lambda t: F.get("window", F.pmod(turn + t, n).cast("int")))
    return w.select("module", "subject", wrong.alias("wrong"))


def edge_cards(template: str, edges: DataFrame, pool: DataFrame) -> DataFrame:
    """A card for each subject with a related file: which of these is related; edges: module, subject, path."""
    s = edges.groupBy("module", "subject").agg(F.min("path").alias("answer"))
    d = distractors(s, pool, edges)
    return s.join(d, ["module", "subject"]).filter(F.size("wrong") >= LEAST_OPTIONS).select(F.lit(template).alias("template"), "module", "subject", F.col("subject").alias("told"), "answer", "wrong")


def which_does_it_import(f: DataFrame, e: DataFrame) -> DataFrame:
    return edge_cards("which_does_it_import", e.select(F.col("m").alias("module"), F.col("a").alias("subject"), F.col("b").alias("path")), f.select("module", "path"))


def who_imports_it(f: DataFrame, e: DataFrame) -> DataFrame:
    return edge_cards("who_imports_it", e.select(F.col("m").alias("module"), F.col("b").alias("subject"), F.col("a").alias("path")), f.select("module", "path"))


def top_cards(template: str, f: DataFrame, key: Column, unique: bool) -> DataFrame:
    """A card for each module of four files or more: the first by ``key``; ``unique`` asks that it leads the second."""
    own = W.partitionBy("module").orderBy(key, "path")
    t = f.withColumn("v", key).withColumn("k", F.row_number().over(own)).filter("k <= 4")
    g = t.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("k", "path", "v"))).alias("t")).filter(F.size("t") == 4)
    if unique:
        g = g.filter(F.col("t")[0]["v"] < F.col("t")[1]["v"])
    paths = F.transform("t", lambda x: x["path"])
    return g.select(F.lit(template).alias("template"), "module", F.get(paths, 0).alias("subject"), F.col("module").alias("told"), F.get(paths, 0).alias("answer"), F.slice(paths, 2, 3).alias("wrong"))


def most_depended_on(f: DataFrame, e: DataFrame) -> DataFrame:
    return top_cards("most_depended_on", f, -F.col("fan_in"), True)


def reading_order(f: DataFrame, e: DataFrame) -> DataFrame:
    return top_cards("reading_order", f, F.col("rank"), False)


def closest_to_entry(f: DataFrame, e: DataFrame) -> DataFrame:
    """A card for each module of four files or more that an entry reaches: the first by layer and path, against up to three of deeper layers.

    Files that no entry reaches (layer null) are neither answer nor option; a module without two deeper files has no card.
    """
    known = f.filter("layer is not null").select("module", "path", "layer")
    top = known.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("layer", "path")).alias("top")).filter("n >= 4")
    deeper = known.join(top.select("module", "top"), "module").filter(F.col("layer") > F.col("top.layer"))
    own = W.partitionBy("module").orderBy("layer", "path")
    wrong = deeper.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= OPTIONS).groupBy("module", "top").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("wrong"))
    answer = F.col("top.path")
    return wrong.filter(F.size("wrong") >= LEAST_OPTIONS).select(F.lit("closest_to_entry").alias("template"), "module", answer.alias("subject"), F.col("module").alias("told"), answer.alias("answer"), "wrong")


#: Templates by name; a further one is a function of the same two tables.
TEMPLATES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "which_does_it_import": which_does_it_import, "who_imports_it": who_imports_it, "most_depended_on": most_depended_on, "closest_to_entry": closest_to_entry, "reading_order": reading_order,
}


def rejected(told: Column, answer: Column, wrong: Column) -> Column:
    """Why a card is no good, null if it is: an answer among the wrong options, equal options, or a name that gives it away."""
    tokens = name_tokens(told)
    lead = similarity(tokens, name_tokens(answer)) - F.array_max(F.transform(wrong, lambda w: similarity(tokens, name_tokens(w))))
    return F.when(F.array_contains(wrong, answer), "answer among the others").when(F.size(F.array_distinct(wrong)) < F.size(wrong), "equal options").when((F.size(tokens) > 0) & (lead > MOST_LEAD), "told by the name")


def generate(spark: SparkSession, sf: str, source: str = "deterministic", most: int = MOST_CARDS) -> DataFrame:
    """module, position, template, subject, answer, options: a few cards of each module, in turn by template."""
    if source != "deterministic":
        raise NotImplementedError(f"no card source {source!r}: only deterministic ones are made here")
    f, e = module_facts(spark, sf)
    f = f.join(layers(*whole_graph(spark, sf), file_components(spark, sf)), "id")
    return chosen(drafts(f, e), most)


def drafts(f: DataFrame, e: DataFrame) -> DataFrame:
    """template, module, subject, told, answer, wrong, reason (null: a good card) of every card that a template makes."""
    all_ = reduce(DataFrame.unionByName, (make(f, e) for make in TEMPLATES.values()))
    return all_.withColumn("reason", rejected(F.col("told"), F.col("answer"), F.col("wrong")))


def rejections(drafted: DataFrame) -> DataFrame:
    """template, reason, n of the drafts that are no good."""
    return drafted.filter("reason is not null").groupBy("template", "reason").agg(F.count(F.lit(1)).alias("n"))


def chosen(drafted: DataFrame, most: int = MOST_CARDS) -> DataFrame:
    """The cards that a module keeps of its good drafts, up to ``most``."""
    # A template's card past its ``most``-th turn can't be among the first ``most`` of its module.
    turn = F.row_number().over(W.partitionBy("module", "template").orderBy("subject"))
    good = drafted.filter("reason is null").withColumn("turn", turn).filter(F.col("turn") <= most)
    c = good.withColumn("position", F.row_number().over(W.partitionBy("module").orderBy("turn", "template")) - 1).filter(F.col("position") < most)
    shown = shortest_distinct(F.concat(F.array("answer"), "wrong"))
    return c.select("module", "position", "template", "subject", F.get(shown, 0).alias("answer"), F.array_sort(shown).alias("options"))


_TOKENS = "list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")))"
CARDS_SQL = f"""{G1_SQL}, {FILES_SQL}, fi AS (SELECT dst, count(*) AS n FROM g1 GROUP BY 1), fc AS (SELECT id, path, cluster AS module, coalesce(n, 0) AS fan_in, row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) AS rank FROM files LEFT JOIN fi ON dst = id),
ie AS (SELECT a.module AS module, a.path AS a, b.path AS b FROM g1 JOIN fc a ON a.id = src JOIN fc b ON b.id = dst WHERE src <> dst AND a.module = b.module),
te AS (SELECT 'which_does_it_import' AS template, module, a AS subject, b AS path FROM ie UNION ALL SELECT 'who_imports_it', module, b, a FROM ie), sj AS (SELECT template, module, subject, min(path) AS answer FROM te GROUP BY 1, 2, 3),
cd AS (SELECT sj.*, fc.path, row_number() OVER (PARTITION BY template, sj.module, subject ORDER BY len(list_intersect({_TOKENS.format(x='answer')}, {_TOKENS.format(x='fc.path')})) DESC, fc.path) - 1 AS k FROM sj JOIN fc ON fc.module = sj.module AND fc.path <> subject AND fc.path <> answer WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.template = sj.template AND te.module = sj.module AND te.subject = sj.subject AND te.path = fc.path))"""


@query("card_candidates", f"WITH {CARDS_SQL} SELECT template, module, subject, answer, count(*) AS window_size FROM cd WHERE k < 12 GROUP BY 1, 2, 3, 4")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Of each subject: the answer, and how many files its wrong options are taken from."""
    f, e = module_facts(spark, sf)
    many = f.groupBy("module", "path").agg(F.count(F.lit(1)).alias("n"))
    whole = f.groupBy("module").agg(F.count(F.lit(1)).alias("whole"))
    out = None
    for template, a, b in (("which_does_it_import", "a", "b"), ("who_imports_it", "b", "a")):
        t = e.select(F.col("m").alias("module"), F.col(a).alias("subject"), F.col(b).alias("path"))
        s = t.groupBy("module", "subject").agg(F.min("path").alias("answer"))
        # All files of the module but the subject and what it may be answered with: counted, as how alike they are doesn't matter here.
        barred = t.unionByName(s.select("module", "subject", F.col("subject").alias("path"))).distinct().join(many, ["module", "path"]).groupBy("module", "subject").agg(F.sum("n").alias("barred"))
        left = s.join(barred, ["module", "subject"]).join(whole, "module").withColumn("left", F.col("whole") - F.col("barred")).filter("left > 0")
        n = left.select("module", "subject", "answer", F.least("left", F.lit(WINDOW).cast("long")).alias("window_size"), F.lit(template).alias("template"))
        out = n if out is None else out.unionByName(n)
    return out


@query("card_most_depended", f"WITH {CARDS_SQL}, r AS (SELECT module, path, fan_in, row_number() OVER (PARTITION BY module ORDER BY fan_in DESC, path) AS k FROM fc) SELECT a.module, a.path AS answer, a.fan_in FROM r a JOIN r b ON a.module = b.module AND a.k = 1 AND b.k = 2 WHERE a.fan_in > b.fan_in AND (SELECT count(*) FROM fc WHERE fc.module = a.module) >= 4")
def most_depended_query(spark: SparkSession, sf: str) -> DataFrame:
    f, e = module_facts(spark, sf)
    c = most_depended_on(f, e)
    return c.join(f.select(F.col("path").alias("answer"), "fan_in"), "answer").select("module", "answer", "fan_in")


@query("card_reading_order", f"WITH {CARDS_SQL} SELECT module, arg_min(path, rank) AS answer FROM fc GROUP BY 1 HAVING count(*) >= 4")
def reading_query(spark: SparkSession, sf: str) -> DataFrame:
    f, e = module_facts(spark, sf)
    return reading_order(f, e).select("module", "answer")


CLOSEST_SQL = f"""{THIN_SQL}, {layer_sql('thin')}, {FILES_SQL}, ly AS (SELECT cluster AS module, path, hop AS layer FROM files JOIN scc ON scc.id = files.id JOIN bfs ON bfs.id = scc_id),
tp AS (SELECT module, min(layer) AS lo, arg_min(path, (layer, path)) AS answer FROM ly GROUP BY 1 HAVING count(*) >= 4), dp AS (SELECT module, answer, lo, path, row_number() OVER (PARTITION BY module ORDER BY layer, path) AS k FROM ly JOIN tp USING (module) WHERE layer > lo)"""


@query("card_closest_entry", f"WITH RECURSIVE {CLOSEST_SQL} SELECT module, answer, CAST(lo AS INTEGER) AS layer, string_agg(path, '|' ORDER BY k) AS wrong FROM dp WHERE k <= {OPTIONS} GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST_OPTIONS}")
def closest_query(spark: SparkSession, sf: str) -> DataFrame:
    """On the thin graph: in the whole one nearly all files share a component, so a layer."""
    f = files(spark, sf).select("id", "path", F.col("cluster").alias("module")).join(written(layers(*thin_graph(spark, sf)), "layers"), "id")
    c = closest_to_entry(f, f).select("module", "answer", F.array_join("wrong", "|").alias("wrong"))
    return c.join(f.select(F.col("path").alias("answer"), "layer"), "answer").select("module", "answer", "layer", "wrong")


@query("card_deck")
def deck(spark: SparkSession, sf: str) -> DataFrame:
    return generate(spark, sf)


@query("card_grades", "SELECT item_id, item_id % 2 = 0 AS correct, CASE WHEN item_id % 2 = 0 THEN 100 ELSE 0 END AS score FROM benchmark")
def grades(spark: SparkSession, sf: str) -> DataFrame:
    """Answers are right if they are equal once cased and spaced alike."""
    given = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" \n"))).otherwise(F.concat("text", F.lit(" not")))
    right = graded_form(given) == graded_form(F.col("text"))
    from graphloom.session import table

    return table(spark, sf, "benchmark").select("item_id", right.alias("correct"), F.when(right, 100).otherwise(0).alias("score"))


@query("card_quality", f"WITH {CARDS_SQL}, s AS (SELECT a.id, {_TOKENS.format(x='a.path')} AS t, {_TOKENS.format(x='b.path')} AS x, {_TOKENS.format(x='c.path')} AS y FROM fc a JOIN fc b ON b.id = (a.id * 7 + 1) % (SELECT count(*) FROM fc) JOIN fc c ON c.id = (a.id * 11 + 5) % (SELECT count(*) FROM fc)) SELECT id, len(list_intersect(t, x)) / (len(t) + len(x) - len(list_intersect(t, x))) - len(list_intersect(t, y)) / (len(t) + len(y) - len(list_intersect(t, y))) > .34 AS guessable FROM s")
def quality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a name gives the answer away against one wrong option."""
    f = files(spark, sf).select("id", "path")
    n = F.broadcast(f.agg(F.count(F.lit(1)).alias("n")))  # one row
    a = f.crossJoin(n).select("id", F.col("path").alias("told"), F.pmod(F.col("id") * 7 + 1, "n").alias("x"), F.pmod(F.col("id") * 11 + 5, "n").alias("y"))
    j = a.join(f.toDF("x", "answer"), "x").join(f.toDF("y", "wrong"), "y")
    t = name_tokens(F.col("told"))
    return j.select("id", (similarity(t, name_tokens(F.col("answer"))) - similarity(t, name_tokens(F.col("wrong"))) > MOST_LEAD).alias("guessable"))
