"""Queries of round 4's findings against their SQL on small tables made for them."""

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.catalog import ORACLE_SQL, QUERIES
from graphloom.operators import code, communities
from tests.test_queries import plain


@pytest.fixture
def tables(tmp_path):
    """Puts tables (name, SQL of its rows) into a folder, and compares a query with its SQL there."""

    class Tables:
        path = str(tmp_path)
        con = duckdb.connect()

        def put(self, name, rows):
            self.con.execute(f"COPY ({rows}) TO '{self.path}/{name}.parquet'")
            self.con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{self.path}/{name}.parquet'")

        def compared(self, spark, name):
            df, r = QUERIES[name](spark, self.path), self.con.sql(ORACLE_SQL[name])
            columns = sorted(df.columns)
            assert columns == sorted(r.columns)
            ours = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
            at = [r.columns.index(c) for c in columns]
            assert ours == sorted(repr([plain(row[i]) for i in at]) for row in r.fetchall())
            return ours

    return Tables()


def test_findings_queue_of_crowded_deep_folders(spark, tables):
    tables.put("part", "SELECT i AS p_partkey, ['old rod', 'new rod', 'old gear'][i % 3 + 1] AS p_name, 'Brand#' || i % 2 AS p_brand, 'PROMO' AS p_type, i // 6 % 4 + 1 AS p_size, 1.0 AS p_retailprice FROM range(400) t(i)")
    assert any("True" in row for row in tables.compared(spark, "agg_findings_queue"))


def test_speaking_overall_of_a_half_and_of_errors_alone(spark, tables):
    """4 and 5 make 45; the user of errors alone has no row."""
    tables.put("events", "SELECT event_id, 1 AS user_id, 'error' AS event_type FROM range(5) t(event_id) UNION ALL SELECT * FROM (VALUES (4, 2, 'view'), (5, 2, 'click'), (1, 2, 'error'))")
    assert tables.compared(spark, "misc_speaking_overall") == ["[45, 2]"]


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_spearman_of_ranks_that_are_all_tied(spark, tables, n):
    tables.put("customer", f"SELECT i * 37 + 36 AS c_custkey, i % 9 + 0.5 AS c_acctbal FROM range({n}) t(i)")
    tables.compared(spark, "st_spearman_top")


def test_ablation_that_leaves_one_file(spark, tables):
    """Without their mark the nineteen entries that nothing else speaks for give way to files of earlier paths."""
    tables.put("part", "SELECT i AS p_partkey, 'old rod' AS p_name, 'Brand#1' AS p_brand, CASE WHEN i <= 20 THEN 'PROMO' ELSE 'LARGE' END AS p_type, CASE WHEN i <= 20 THEN 1 ELSE 5 END AS p_size, 1.0 AS p_retailprice FROM range(1, 61) t(i)")
    tables.put("lineitem", "SELECT 1 AS l_orderkey, 20 AS l_partkey, 1 AS l_suppkey, i AS l_linenumber, 1.0 AS l_quantity, 0.0 AS l_discount, 'A' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1995-01-01' AS l_shipdate FROM range(1, 4) t(i)")
    assert any("nan" in row for row in tables.compared(spark, "st_ablation"))


def test_a_question_of_many_imports_is_asked_once(spark):
    """A path tells what it answers, so a base is one row whatever is tried for it; every import gets its answer."""
    p = spark.createDataFrame([("web/lib/x.tsx",), ("src/lib/y.py",), ("web/z/index.js",), ("pkg/__init__.py",)], "path string")
    assert {tuple(r) for r in code.bases_of(p).filter("python or nth > 0").collect()} == {
        ("web/lib/x.tsx", False, "web/lib/x", 2), ("src/lib/y.py", True, "src/lib/y", 0), ("web/z/index.js", False, "web/z/index", 3), ("web/z/index.js", False, "web/z", 7), ("pkg/__init__.py", True, "pkg/__init__", 0), ("pkg/__init__.py", True, "pkg", 1),
    }
    rows = [(k, f"web/a{k}.ts", "@/lib/x", None) for k in range(50)] + [(100 + k, f"web/b{k}/a.ts", "../z", None) for k in range(50)] + [(200 + k, f"app/a{k}.py", "lib.y", "f") for k in range(50)]
    i = spark.createDataFrame(rows, "id long, path string, specifier string, name string")
    r = code.resolve(i, p, aliases=spark.createDataFrame([("", "@/*", ["web/*"])], "dir string, alias string, targets array<string>"))
    assert sorted((x.id, x.target) for x in r.collect()) == [(k + n, t) for n, t in ((0, "web/lib/x.tsx"), (100, "web/z/index.js"), (200, "src/lib/y.py")) for k in range(50)]


def test_kinds_of_names_by_words():
    """Bases over lines, names with other signs, and words that only begin like a name; all of a file in one pass."""
    text = "import ...\nclass A(x.B,\n  C): pass\nD (1)\n$e + $e\nFoo Foo Foo Foo F\n"
    i = [{"names": list("BCDF"), "locals": ["B", "C", "D", "F"], "line": 1, "reexport": False}, {"names": [], "locals": ["g"], "line": 1, "reexport": False}, {"names": ["e"], "locals": ["e"], "line": 1, "reexport": False}]
    assert code.use_kinds(text, i) == [["inherits", "inherits", "calls", "light_use"], ["type_only"], ["light_use"]]


def test_windows_of_options_without_all_pairs():
    """By common names, then by path; what is barred and the subject itself are left out, equal paths stay rows of their own."""
    from graphloom.operators.cards import windows

    pool = pd.DataFrame({"path": ["x/d", "x/c", "y/b", "y/a", "y/a", "x/z"], "tokens": [["x", "d"], ["x", "c"], ["y", "b"], ["y", "a"], ["y", "a"], ["x", "z"]]})
    asked = pd.DataFrame({"module": ["m", "m"], "subject": ["x/d", "y/b"], "answer": ["x/z", "x/c"], "tokens": [["x", "z"], ["x", "c"]], "barred": [["x/z"], None]})
    assert {r.subject: r.window for r in windows(asked, pool).itertuples()} == {"x/d": ["x/c", "y/a", "y/a", "y/b"], "y/b": ["x/d", "x/z", "y/a", "y/a"]}


def test_candidates_are_counted_without_pairs(spark, tables):
    """A join of each subject with all files of its module isn't in the plan; the counts are the SQL's, also where files run out."""
    tables.put("part", "SELECT i AS p_partkey, 'old rod' AS p_name, 'Brand#' || i % 3 AS p_brand, 'PROMO' AS p_type, i % 7 AS p_size, 1.0 AS p_retailprice FROM range(60) t(i)")
    tables.put("lineitem", "SELECT i // 5 AS l_orderkey, i * i * 3 % 60 AS l_partkey, 1 AS l_suppkey, i % 5 AS l_linenumber, 1.0 AS l_quantity, 0.0 AS l_discount, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(900) t(i)")
    assert tables.compared(spark, "card_candidates")
    plan = QUERIES["card_candidates"](spark, tables.path)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"NOT \(path#\d+ = (subject|answer)#", plan)


def test_fragments_without_places(spark, tables):
    """Names are told apart where texts are read: of many texts no window and no join is needed."""
    tables.put("customer", "SELECT i AS c_custkey, 'Ann ' || i AS c_name, 'BUILDING' AS c_mktsegment FROM range(40) t(i)")
    assert len(tables.compared(spark, "txt_fragments")) > 3
    plan = QUERIES["txt_fragments"](spark, tables.path)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_similar_names_meet_as_classes(spark, tables):
    """Two hundred files with equal names but for their numbers are a few classes; only these meet."""
    tables.put("part", "SELECT i AS p_partkey, ['old rod', 'old gear', 'hot rod'][i % 3 + 1] AS p_name, 'Brand#' || i // 100 AS p_brand, 'PROMO' AS p_type, i % 5 AS p_size, 1.0 AS p_retailprice FROM range(200) t(i)")
    assert len(tables.compared(spark, "set_pairwise_similarity")) > 1000
    plan = QUERIES["set_pairwise_similarity"](spark, tables.path)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[a#\d+L?, b#\d+L?\]", plan) and "class#" in plan


@pytest.mark.parametrize("method", [communities.louvain, communities.greedy])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_communities_by_component(spark, method, kind):
    """Rings of cliques: a component's communities are the same by itself and by rounds of all, and good ones."""
    cliques = [[(f"{c}{x}", f"{c}{y}", 1.0) for x in range(4) for y in range(x)] for c in range(1, 9)]
    edges = [(min(a, b), max(a, b), w) for c in cliques for a, b, w in c] + [(f"{c}0", f"{c + 1}1", 0.2) for c in (1, 2, 3, 5, 6, 7)]
    e = spark.createDataFrame(edges, "a string, b string, weight double").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "weight")
    n = spark.createDataFrame([(f"{c}{x}",) for c in range(1, 10) for x in range(4)], "id string").select(F.col("id").cast(kind).alias("id"))
    grouped = lambda labels: {frozenset(str(r.id) for r in labels.collect() if r.cluster == c) for c in {r.cluster for r in labels.collect()}}
    assert grouped(method(e, n)) == grouped(method(e, n, most=10)) == {frozenset(f"{c}{x}" for x in range(4)) for c in range(1, 9)} | {frozenset([f"9{x}"]) for x in range(4)}
