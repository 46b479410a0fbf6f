"""Communities and rank statistics on small graphs and lists whose answers are known."""

import itertools
import random

import pytest

from graphloom.operators import communities, neighborhood, ranking
from graphloom.operators.graph import condensed, layers, nodes_of, strong_components
from graphloom.plans.rounds import fractional, ordinal
from pyspark.sql import functions as F


def two_groups(spark):
    pairs = [(a, b, 1.0) for g in (range(0, 4), range(4, 8)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 0.1)]
    return spark.createDataFrame(pairs, "a long, b long, weight double"), spark.createDataFrame([(i,) for i in range(9)], "id long")


@pytest.mark.parametrize("method", [communities.louvain, communities.greedy])
def test_two_dense_groups_and_an_isolate(spark, method):
    e, n = two_groups(spark)
    labels = method(e, n)
    got = {r.id: r.cluster for r in labels.collect()}
    assert len({got[i] for i in range(4)}) == len({got[i] for i in range(4, 8)}) == 1 and len(set(got.values())) == 3
    value = communities.modularity(e, labels)
    whole, inside = 2 * 12.1, 2 * 12.0
    assert value == pytest.approx(inside / whole - 2 * (12.1 / whole) ** 2)
    assert {(r.id, r.cluster, r.size) for r in communities.numbered(labels).collect()} == {(i, i // 4, 4) for i in range(8)} | {(8, 2, 1)}


def test_no_merge_or_move_lowers_the_objective(spark):
    rng = random.Random(2)
    pairs = {(min(p), max(p)): rng.choice([0.25, 0.8, 1.0]) for p in (rng.sample(range(24), 2) for _ in range(70))}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight double")
    n = spark.createDataFrame([(i,) for i in range(24)], "id long")
    alone = communities.modularity(e, n.select("id", F.col("id").alias("cluster")))
    for method in (communities.louvain, communities.greedy):
        labels = {r.id: r.cluster for r in method(e, n).collect()}
        strength, inside = {}, {}
        for (a, b), w in pairs.items():
            for x in (a, b):
                strength[labels[x]] = strength.get(labels[x], 0) + w
            key = tuple(sorted((labels[a], labels[b])))
            inside[key] = inside.get(key, 0) + w
        m2 = sum(strength.values())
        value = sum(2 * w for (x, y), w in inside.items() if x == y) / m2 - sum((s / m2) ** 2 for s in strength.values())
        assert value > alone
        assert all(2 * w / m2 - 2 * strength[x] * strength[y] / m2**2 < 1e-9 for (x, y), w in inside.items() if x != y)


def test_stability_and_coherence(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "id long, cluster long")
    probe = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9), (5, 9)], "id long, cluster long")
    assert {r.cluster: r.stable for r in communities.stability(labels, probe).collect()} == {0: True, 1: False}
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (6, "h")], "id long, group string")
    assert {r.group: (r.size, r.cluster, round(r.coherence, 3), r.weak) for r in communities.cycle_coherence(groups, labels).collect()} == {"g": (3, 0, 0.667, True), "h": (1, None, 1.0, False)}


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (12, 14), (30, 45)):
        pairs = {tuple(rng.choices(range(n), k=2)) for _ in range(m)}
        e = spark.createDataFrame(list(pairs), "src long, dst long") if pairs else spark.createDataFrame([], "src long, dst long")
        reach = {i: {i} for i in range(n)}
        for _ in range(n):
            for a, b in pairs:
                for i in range(n):
                    if a in reach[i]:
                        reach[i].add(b)
        expected = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
        got = {r.id: r.scc_id for r in strong_components(e, spark.createDataFrame([(i,) for i in range(n)], "id long")).collect()}
        assert got == expected


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert strong_components(none, nodes_of(none)).count() == 0


def test_layers_start_from_whole_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (6, 5)], "src long, dst long")
    got = layers(e, nodes_of(e), spark.createDataFrame([(2,)], "id long"))
    assert {r.id: r.layer for r in got.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: None}
    c = strong_components(e, nodes_of(e))
    assert {tuple(r) for r in condensed(e, c).collect()} == {(1, 3), (3, 5), (6, 5)}
    with pytest.raises(ValueError):
        neighborhood.longest_layers(e, nodes_of(e))


def test_kendall_against_all_pairs(spark):
    rng = random.Random(9)
    for rows in ([(rng.randint(0, 9), rng.randint(0, 5)) for _ in range(60)], [(k, -k) for k in range(20)], [(1, 2)], [(1, k) for k in range(5)]):
        pairs = list(itertools.combinations(rows, 2))
        sign = lambda x: (x > 0) - (x < 0)
        s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a, b in pairs]
        below = (sum(abs(x) for x, _ in s) * sum(abs(y) for _, y in s)) ** 0.5
        expected = sum(x * y for x, y in s) / below if below else None
        got = ranking.kendall_tau(spark.createDataFrame(rows, "x int, y int")).first().tau
        assert got == (expected if expected is None else pytest.approx(expected))


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    values = [rng.choice([None, *range(6)]) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(values)), "id long, v int")
    order = sorted(range(40), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    assert {r.id: r.rank for r in ordinal(d, [F.desc_nulls_last("v")], ["id"], "rank").collect()} == {i: k + 1 for k, i in enumerate(order)}
    present = [v for v in values if v is not None]
    expected = {i: None if v is None else sum(x > v for x in present) + (present.count(v) + 1) / 2 for i, v in enumerate(values)}
    assert {r.id: r.rank for r in fractional(d, "v", "rank").collect()} == expected


def test_greedy_matching_takes_the_largest_overlap_first(spark):
    from graphloom.operators.modules import matched

    old = spark.createDataFrame([(i, "a") for i in range(5)] + [(i, "b") for i in range(5, 8)], "id long, old string")
    new = spark.createDataFrame([(i, "x") for i in (0, 1, 2, 5, 6, 7)] + [(3, "y"), (4, "y")], "id long, new string")
    assert {tuple(r) for r in matched(old, new).collect()} == {("b", "x", 1.0)}
    assert {tuple(r) for r in matched(old, new, 0.4).collect()} == {("b", "x", 1.0), ("a", "y", 0.4)}


def test_entries_come_from_configurations_first(spark):
    from graphloom.operators.modules import entry_points

    configs = spark.createDataFrame([("Dockerfile", "FROM x\nCMD [\"uvicorn\", \"app.main:app\"]\n"), ("web/package.json", '{"main": "./src/index.js"}'), ("Procfile", "web: python serve.py")], "path string, content string")
    sources = spark.createDataFrame([(p, "if __name__ == '__main__':\n") for p in ("app/main.py", "web/src/index.js", "serve.py", "other.py")], "path string, content string")
    assert sorted(tuple(r) for r in entry_points(configs, sources).collect()) == [("app/main.py", "config"), ("serve.py", "config"), ("web/src/index.js", "config")]
    assert {r.source for r in entry_points(configs.limit(0), sources).collect()} == {"pattern"}


def test_throttling_against_a_loop(spark):
    from graphloom.operators.timeline import throttled

    rng = random.Random(6)
    rows = [(k, rng.randrange(1000)) for k in (1, 2, 3) for _ in range(60)] + [(9, 5)]
    expected, since = [], {}
    rows = sorted(set(rows))
    for i, (k, t) in enumerate(rows):
        last = i + 1 == len(rows) or rows[i + 1][0] != k
        ok = k not in since or t - since[k] >= 50
        if ok:
            since[k] = t
        if ok or last:
            expected.append((k, t))
    got = throttled(spark.createDataFrame(rows, "k long, t long"), "k", "t", 50)
    assert sorted((r.k, r.t) for r in got.filter("passed").collect()) == expected


def test_scorers_by_name(spark):
    from graphloom.plans import extensions
    from tests.conftest import SF

    with pytest.raises(ValueError):
        extensions.scores(spark, SF, "none")
    got = extensions.comparison(spark, SF).collect()
    assert len(got) == 3 and all(0 <= r.overlap <= 20 and -1 <= r.tau <= 1 for r in got)
    extensions.register_sql_functions(spark)
    assert spark.sql("SELECT python_nloc('x = 1\\n\\n# c\\n'), python_complexity('def f(:')").first()[:] == (1, None)
