"""Graph operators on tiny graphs whose answers are known."""

import random

import duckdb
import pytest

from graphloom.operators import graph
from graphloom.operators.graph import layers, nodes_of, pagerank, strong_components
from graphloom.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF


def frame(spark, rows, schema="src long, dst long"):
    return spark.createDataFrame(rows, schema)


def test_pagerank_of_a_cycle_is_even(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1)])
    assert [r.rank for r in pagerank(e, nodes_of(e)).collect()] == pytest.approx([1 / 3] * 3, abs=1e-6)


def test_pagerank_follows_weights_from_the_seed(spark):
    e = frame(spark, [(1, 2, 1.0), (1, 3, 0.25)], "src long, dst long, weight double")
    r = {x.id: x.rank for x in pagerank(e, nodes_of(e), 0.65, seeds=frame(spark, [(1,)], "id long")).collect()}
    assert r[2] / r[3] == pytest.approx(4, abs=1e-3) and sum(r.values()) == pytest.approx(1)


def test_strong_components(spark):
    e = frame(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6)])
    assert {r.id: (r.scc_id, r.scc_size) for r in strong_components(e, nodes_of(e)).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (6, 1)}


def test_layers_leave_unreachable_nodes_null(spark):
    e = frame(spark, [(1, 2), (2, 3), (4, 5)])
    assert {r.id: r.layer for r in layers(e, nodes_of(e), frame(spark, [(1,)], "id long")).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None}


def test_layers_go_on_until_the_frontier_is_empty(spark, monkeypatch):
    """No number of rounds ends the walk; a loop over range(), cut to two rounds here, would."""
    monkeypatch.setattr(graph, "range", lambda *a: [1, 2], raising=False)
    e = frame(spark, [(i, i + 1) for i in range(1, 7)])
    assert {r.id: r.layer for r in layers(e, nodes_of(e), frame(spark, [(1,)], "id long")).collect()} == {i: i - 1 for i in range(1, 8)}


def plain_components(edges, n):
    out = {i: set() for i in range(n)}
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[i] = seen
    own = {i: [j for j in reach[i] if i in reach[j]] for i in range(n)}
    return {i: (min(m), len(m)) for i, m in own.items()}


@pytest.mark.parametrize("giant, small", [(60, 0), (40, 12), (0, 15)])
def test_strong_components_of_random_graphs(spark, giant, small):
    """A giant component with tails in and out of it, many small ones, or both, and isolated nodes."""
    rng, edges, n = random.Random(giant), [], giant
    edges += [(rng.randrange(giant), rng.randrange(giant)) for _ in range(4 * giant)]
    for _ in range(small):
        k = rng.randint(1, 5)
        edges += [(n + i, n + (i + 1) % k) for i in range(k)] + ([(n, rng.randrange(n))] if n and rng.random() < 0.7 else [])
        n += k
    edges += [(n + i, n + i + 1) for i in range(6)] + ([(rng.randrange(giant), n)] if giant else [])
    n += 9
    rng.shuffle(edges)
    e = frame(spark, edges)
    got = {r.id: (r.scc_id, r.scc_size) for r in strong_components(e, spark.range(n)).collect()}
    assert got == plain_components(edges, n)


def test_depth_is_bounded_by_cycles(spark):
    from graphloom.operators.neighborhood import bounded_depth, layers_of_condensation

    e, n = frame(spark, [(1, 2), (2, 3), (3, 4), (4, 3), (4, 5), (1, 5), (6, 7), (7, 8)]), spark.range(1, 9)
    assert {r.id: r.depth for r in bounded_depth(e, n).collect()} == {1: 0, 2: 1, 3: 7, 4: 7, 5: 7, 6: 0, 7: 1, 8: 2}
    assert {r.id: r.layer for r in layers_of_condensation(e, n).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 6: 0, 7: 1, 8: 2}


def test_walk_of_a_long_chain_keeps_few_tables(spark):
    e = frame(spark, [(i, i + 1) for i in range(1, 20)])
    assert {r.id: r.hop for r in graph.walk(e, frame(spark, [(1,)], "id long")).collect()} == {i: i - 1 for i in range(1, 21)}


def rows_and_sql(spark, folder, name, orders, parts):
    """A query's rows and its SQL's on tables of these parts and orders' parts, line by line."""
    line, part = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    one, other = line.first().asDict(), part.first().asDict()
    lines = [one | {"l_orderkey": i, "l_linenumber": k, "l_partkey": p} for i, o in enumerate(orders) for k, p in enumerate(o, 1)]
    spark.createDataFrame([tuple(x[c] for c in line.columns) for x in lines], line.schema).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([tuple((other | {"p_partkey": p})[c] for c in part.columns) for p in parts], part.schema).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    r = con.sql(ORACLE_SQL[name])
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*r.columns).collect())), sorted(r.fetchall())


@pytest.mark.parametrize("orders, parts, want", [
    ([(1, 2, 1), (2, 3), (3, 4, 5, 3), (6, 6), (7, 1), (5, 8)], range(1, 10), [(1, 3), (3, 8), (7, 1)]),
    ([(5, 99, 6), (6, 5), (6, 7, 8), (15, 2, 15), (15, 16, 15), (16, 17), (17, 3, 17)], [5, 6, 7, 8, 15, 16, 17], [(2, 3), (5, 7), (7, 8)]),
], ids=["several components", "held together and named by unknown parts"])
def test_condensation_query(spark, tmp_path, orders, parts, want):
    """The given tables are one component, so their condensation has no edges; these have some."""
    ours, sql = rows_and_sql(spark, tmp_path, "gr_condensation", orders, parts)
    assert ours == sql == want


def test_entry_nodes_query(spark, tmp_path):
    """Every part of the given tables has an importer; here 7 and 9 have none, 6 only itself."""
    ours, sql = rows_and_sql(spark, tmp_path, "gr_entry_nodes", [(1, 2, 1), (2, 3), (3, 4, 5, 3), (6, 6), (7, 1), (5, 8)], range(1, 10))
    assert ours == sql == [(6,), (7,), (9,)]
