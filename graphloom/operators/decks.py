"""Regeneration of a deck: a three-way merge of the cards that stand, fresh ones and their reviews, with counts that must add up.

A deck is a snapshot log of cards. Old and fresh cards meet by (module, template, subject) in one join, whose rows are
written once; what is created and deleted is counted by the job that writes them, and the next version is committed
only if the rows that it wrote are those of the version before, plus the created, less the deleted ones.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.cards import module_facts, most_depended_on, reading_order
from graphloom.operators.graph import THIN_SQL, degrees, thin_graph
from graphloom.plans.projections import FILES_SQL, G1_SQL, files
from graphloom.plans.rounds import Round, ordinal, shared_dir, written
from graphloom.registry import query
from graphloom.session import table
from graphloom.sources.snapshots import SnapshotLog

KEY = ["module", "template", "subject"]
CARD = [*KEY, "answer", "options"]


class NotConserved(RuntimeError):
    """A regeneration's rows don't add up."""


def merged(old: DataFrame, fresh: DataFrame, modules: DataFrame, reviews: DataFrame) -> DataFrame:
    """The columns of a card, ``state``, ``n_reviews`` and ``n_right`` of every old or fresh card.

    state: untouched (an old card of a module that isn't among ``modules``), kept (its answer and options are as they
    were), changed, created or deleted. Options are sets: their order doesn't change a card. Reviews (of KEY, right)
    count for an old card; those of a card that is changed or deleted are told here, but not carried on. Null modules,
    templates and subjects are values like others; a key that stands twice on one side meets the other side's card
    twice, which the counts of ``regenerate`` bring to light. Other columns are ignored; empty tables are allowed.
    """
    scope = modules.select("module").distinct().withColumn("known", F.lit(True))
    same = lambda a, b, keys: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    n = reviews.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if("right").alias("n_right"))
    old = old.select(*CARD).alias("o").join(n.alias("r"), same("o", "r", KEY), "left").select("o.*", "n_reviews", "n_right")
    old = old.alias("o").join(scope.alias("s"), same("o", "s", ["module"]), "left").select("o.*", "known", F.lit(True).alias("stood"))
    fresh = fresh.select(*CARD).alias("f").join(scope.alias("s"), same("f", "s", ["module"]), "left_semi").withColumn("made", F.lit(True))
    j = old.alias("o").join(fresh.alias("f"), same("o", "f", KEY) & F.col("o.known").isNotNull(), "full")
    alike = F.col("o.answer").eqNullSafe(F.col("f.answer")) & F.array_sort("o.options").eqNullSafe(F.array_sort("f.options"))
    state = F.when(F.col("stood").isNull(), "created").when(F.col("known").isNull(), "untouched").when(F.col("made").isNull(), "deleted").when(alike, "kept").otherwise("changed")
    now = lambda c: F.when(F.col("made").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select(*map(now, CARD), state.alias("state"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def regenerate(deck: SnapshotLog, fresh: DataFrame, modules: DataFrame, reviews: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """Commits the deck's next version; returns its counts and the merged rows (``merged``).

    Counts: before, after, one of each state, reviews (all that are given), carried (of cards that stay as they were),
    set_aside (of changed and deleted ones), unknown (of no card of the deck). An error leaves the deck as it was:
    NotConserved where after isn't before + created - deleted, ValueError where there are no modules.
    """
    if modules.isEmpty():
        raise ValueError("no modules to make cards for")
    parent = deck.versions()[-1]
    asked = Round(reviews.select(*KEY, "right"), "reviews", n=F.count(F.lit(1)))
    is_ = lambda *s: F.col("state").isin(*s)
    states = {s: F.count_if(is_(s)) for s in ("untouched", "kept", "changed", "created", "deleted")}
    total = lambda *s: F.coalesce(F.sum(F.when(is_(*s), F.col("n_reviews"))), F.lit(0))
    r = Round(merged(deck.read(parent), fresh, modules, asked.table), "merged", **states, carried=total("kept", "untouched"), set_aside=total("changed", "deleted"))
    asked.delete()
    counts = {"before": deck.manifest(parent)["rows"], **{k: int(v) for k, v in r.metrics.items()}, "reviews": int(asked.metrics["n"])}
    counts["unknown"] = counts["reviews"] - counts["carried"] - counts["set_aside"]

    def check(after: int) -> None:
        expected = counts["before"] + counts["created"] - counts["deleted"]
        if after != expected:
            raise NotConserved(f"{counts['before']} cards, {counts['created']} created and {counts['deleted']} deleted make {expected}, but {after} were written")
        if counts["unknown"] < 0:
            raise NotConserved(f"{counts['carried'] + counts['set_aside']} reviews of cards, but only {counts['reviews']} were given")
        counts["after"] = after

    deck.commit(r.table.filter("state <> 'deleted'").select(*CARD), parent, check)
    return counts, r.table


def without_cards(modules: DataFrame, rows: DataFrame) -> DataFrame:
    """The modules that a regeneration leaves without a card: a finding, not a gap."""
    live = rows.filter("state <> 'deleted'").alias("r")
    return modules.select("module").distinct().alias("m").join(live, F.col("m.module").eqNullSafe(F.col("r.module")), "left_anti")


_TOP = """SELECT module, path, k, n, first_value(v) OVER w - coalesce(nth_value(v, 2) OVER w, 0) AS lead FROM (SELECT module, path, v, row_number() OVER (PARTITION BY module ORDER BY {order}, path) AS k, count(*) OVER (PARTITION BY module) AS n FROM (SELECT module, path, {v} AS v, rank FROM {f})) WINDOW w AS (PARTITION BY module ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _cards_sql(name: str, edges: str) -> str:
    """Table ``name``: the two kinds of cards that need no rotation, of a table of edges."""
    top = lambda template, v, order, more: f"SELECT module, '{template}' AS template, arg_min(path, k) AS subject, string_agg(path, '|' ORDER BY path) AS options FROM ({_TOP.format(v=v, order=order, f=f'{name}_f')}) WHERE k <= 4 AND n >= 4{more} GROUP BY 1"
    return f"""{name}_n AS (SELECT dst, count(*) AS n FROM {edges} GROUP BY 1), {name}_f AS (SELECT id, path, cluster AS module, coalesce(n, 0) AS fan_in, row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) AS rank FROM files LEFT JOIN {name}_n ON dst = id),
{name} AS ({top('most_depended_on', 'fan_in', 'v DESC', ' AND lead > 0')} UNION ALL {top('reading_order', 'rank', 'v', '')})"""


REGENERATED_SQL = f"""WITH {THIN_SQL}, {G1_SQL[G1_SQL.index('g1 AS'):]}, {FILES_SQL}, {_cards_sql('old', 'thin')}, {_cards_sql('new', 'g1')},
rv AS (SELECT path AS subject, count(*) AS n FROM lineitem JOIN files ON id = l_partkey GROUP BY 1),
m AS (SELECT coalesce(old.module, new.module) AS module, CASE WHEN old.module IS NULL THEN 'created' WHEN new.module IS NULL THEN 'deleted' WHEN old.options = new.options THEN 'kept' ELSE 'changed' END AS state, CASE WHEN old.module IS NOT NULL THEN coalesce(rv.n, 0) ELSE 0 END AS n
  FROM old FULL JOIN new ON old.module = new.module AND old.template = new.template AND old.subject = new.subject LEFT JOIN rv ON rv.subject = old.subject)
SELECT module, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'created') AS created, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state <> 'created') AS before, count(*) FILTER (state <> 'deleted') AS after,
  CAST(coalesce(sum(n) FILTER (state = 'kept'), 0) AS BIGINT) AS carried, CAST(coalesce(sum(n) FILTER (state IN ('changed', 'deleted')), 0) AS BIGINT) AS set_aside FROM m GROUP BY 1"""


def top_facts(edges: DataFrame, f: DataFrame) -> DataFrame:
    """Files (id, path, module) with fan-in and rank in a graph."""
    d = ordinal(degrees(edges, f.select("id")).select("id", "fan_in"), [F.desc("fan_in")], ["id"], "rank")
    return written(f.join(d.select("id", "fan_in", "rank"), "id"), "facts")


@query("card_regenerated", REGENERATED_SQL)
def regenerated(spark: SparkSession, sf: str) -> DataFrame:
    """A deck made of the edges of large quantities, regenerated of all edges: cards and reviews by module.

    A review is a line of the subject's part, right unless it was returned.
    """
    f = files(spark, sf).select("id", "path", F.col("cluster").alias("module"))
    old, new = top_facts(thin_graph(spark, sf)[0], f), module_facts(spark, sf)[0]
    cards = lambda x: most_depended_on(x, x).unionByName(reading_order(x, x)).select(*KEY, "answer", F.array_sort(F.concat(F.array("answer"), "wrong")).alias("options"))
    deck = SnapshotLog(spark, f"{shared_dir(spark)}/graphloom/deck-{uuid.uuid4().hex}")
    deck.commit(cards(old))
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_returnflag") != "R").alias("right"))
    seen = line.join(f.select("id", F.col("path").alias("subject")), "id").join(deck.read().select(*KEY), "subject")
    _, rows = regenerate(deck, cards(new), f.select("module"), seen)
    is_ = lambda *s: F.col("state").isin(*s)
    count = lambda *s: F.count_if(is_(*s))
    total = lambda *s: F.coalesce(F.sum(F.when(is_(*s), F.col("n_reviews"))), F.lit(0))
    return rows.groupBy("module").agg(
        count("kept").alias("kept"), count("changed").alias("changed"), count("created").alias("created"), count("deleted").alias("deleted"),
        count("untouched", "kept", "changed", "deleted").alias("before"), count("untouched", "kept", "changed", "created").alias("after"),
        total("kept", "untouched").alias("carried"), total("changed", "deleted").alias("set_aside"),
    )
