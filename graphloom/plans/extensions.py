"""What can be added by name: scorers, clusterings, topics, cards, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cards, code, communities, modules, ranking

#: Scorers: a name, and the table (id, path, score) that it gives for the files of a directory of tables.
SCORERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "legacy": lambda spark, sf: ranking.composite(ranking.signals(spark, sf), ranking.GRAPH_WEIGHTS | ranking.HISTORY_WEIGHTS),
    "weighted_pagerank": lambda spark, sf: ranking.prior_ranked(spark, sf).select("id", "path", "score"),
    "rrf": lambda spark, sf: (lambda s: ranking.fused(s).join(s.select("id", "path"), "id"))(ranking.signals(spark, sf)),
}
#: Clusterings: a name, and a function of pairs, nodes and a resolution.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {"modularity": communities.greedy, "louvain": communities.louvain}
TOPICS = modules.TOPICS
TEMPLATES = cards.TEMPLATES


def scores(spark: SparkSession, sf: str, scorer: str) -> DataFrame:
    """The scores of a scorer by its name; an unknown name is an error that lists those that there are."""
    if scorer not in SCORERS:
        raise ValueError(f"no scorer {scorer!r}: one of {', '.join(SCORERS)}")
    return SCORERS[scorer](spark, sf)


def comparison(spark: SparkSession, sf: str, n: int = 20) -> DataFrame:
    """a, b, overlap, tau of every two scorers: files in both top lists, and Kendall's tau over all files."""
    from itertools import combinations

    from graphloom.plans.rounds import written

    tables = {k: written(scores(spark, sf, k), "scores") for k in SCORERS}
    out = None
    for a, b in combinations(tables, 2):
        top = lambda t: t.orderBy(F.desc("score"), "path").limit(n).select("id")
        both = tables[a].select("id", F.col("score").alias("x")).join(tables[b].select("id", F.col("score").alias("y")), "id")
        row = top(tables[a]).join(top(tables[b]), "id").agg(F.count(F.lit(1)).alias("overlap")).crossJoin(ranking.kendall_tau(both))  # one row each
        row = row.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "overlap", F.round("tau", 9).alias("tau"))
        out = row if out is None else out.unionByName(row)
    return out


def register_sql_functions(spark: SparkSession) -> None:
    """python_nloc(content) and python_complexity(content) for SQL; null where a text doesn't parse."""

    def measure(key: str) -> Callable[[pd.Series], pd.Series]:
        def of(texts: pd.Series) -> pd.Series:
            found = [code.file_metrics(t) if t is not None else None for t in texts]
            return pd.Series([f[key] if f else None for f in found], dtype="Int32")

        return of

    for name, key in (("python_nloc", "nloc"), ("python_complexity", "max_cyclomatic")):
        f = measure(key)
        f.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(f, "int"))
