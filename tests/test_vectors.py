"""The vector index, its upkeep, block search and the hashing vectoriser, against plain products."""

import numpy as np
import pytest

from graphloom.operators import vectors
from graphloom.operators.vectors import VectorIndex, block_search, fitted, hashed_vectors, probes_for, unit


def clustered(n=600, dimensions=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimensions))
    x = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dimensions))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v) for k, v in enumerate(x.tolist())], "id long, v array<double>")


def brute(x, ids, k, least=-2.0):
    sims = np.round(x[ids] @ x.T, vectors.DIGITS)
    out = set()
    for q, s in zip(ids, sims, strict=True):
        out |= {(q, i) for i in [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q and s[i] >= least][:k]}
    return out


def rows(df):
    return {(r.query_id, r.id) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return VectorIndex.build(frame(spark, clustered()), str(tmp_path_factory.mktemp("index")))


def test_index_holds_every_row_and_finds_nine_of_ten(spark, index):
    x, ids = clustered(), list(range(0, 600, 20))
    assert sorted(r.id for r in index.rows.select("id").collect()) == list(range(600))
    asked = frame(spark, x).filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = brute(x, ids, 5)
    assert rows(index.search(asked, 5, probes=len(index.centroids))) == exact
    assert len(rows(index.search(asked, 5)) & exact) >= 0.9 * len(exact)
    assert 1 <= index.probes < len(index.centroids)


@pytest.mark.parametrize("least", [0.5, 0.9, 0.97])
def test_threshold_search_misses_nothing(spark, index, least):
    x = clustered()
    asked = frame(spark, x).filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    assert rows(index.search(asked, 3, least=least)) == brute(x, list(range(0, 600, 20)), 3, least)


def test_upsert_touches_its_lists_only_and_equals_a_rebuild(spark, tmp_path):
    x = clustered(400, seed=3)
    index = VectorIndex.build(frame(spark, x), str(tmp_path / "index"))
    before = {r.list: r.n for r in index.rows.groupBy("list").count().withColumnRenamed("count", "n").collect()}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "index" / "rows").rglob("*.parquet")}
    own = {r.id: r.list for r in index.rows.select("id", "list").collect()}
    gone = [i for i, k in own.items() if k == own[0]]  # a whole list goes
    changed = [(7, x[11].tolist()), (9999, x[12].tolist()), *((i, None) for i in gone if i != 7)]
    touched = index.upsert(spark.createDataFrame(changed, "id long, v array<double>"))
    assert set(touched) <= {own[0], own[7], own[11], own[12]} and len(touched) < len(before)
    kept = {p for p in files if int(p.parent.name.split("=")[1]) not in touched}
    assert kept and all(p.stat().st_mtime_ns == files[p] for p in kept)
    now = {i: x[i] for i in range(400) if i not in gone} | {7: x[11], 9999: x[12]}
    assert {r.id: np.round(r.v, 12).tolist() for r in index.rows.collect()} == {i: np.round(v, 12).tolist() for i, v in now.items()}
    again = index._dealt(unit(spark.createDataFrame([(i, v.tolist()) for i, v in now.items()], "id long, v array<double>")))
    assert {r.id: r.list for r in again.collect()} == {r.id: r.list for r in index.rows.collect()}


def test_search_in_small_blocks_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    x = clustered(300, seed=5)
    x[250:] = x[3]  # ties go by id
    f = unit(frame(spark, x)).selectExpr("1 AS grp", "id", "v")
    assert rows(block_search(f, f.filter("id % 10 = 0").withColumnRenamed("id", "query_id"), 4)) == brute(x, list(range(0, 300, 10)), 4)


def test_vectors_without_length_are_left_out(spark, tmp_path):
    rows_ = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [2.0, 0.1])]
    df = spark.createDataFrame(rows_, "id long, v array<double>")
    assert sorted(r.id for r in unit(df).collect()) == [1, 7]
    empty = VectorIndex.build(df.limit(0), str(tmp_path / "none"))
    assert empty.search(df.withColumnRenamed("id", "query_id")).count() == 0


def test_probes_reach_the_wanted_recall_on_the_sample():
    x = clustered(500)
    c = fitted(x, 20)
    assert np.allclose((c * c).sum(axis=1), 1)
    assert 1 <= probes_for(x, c, 0.5) <= probes_for(x, c, 0.99) <= 20 and probes_for(x[:1], c) == 1


def test_hashed_vectors(spark):
    got = {r.id: r.v for r in hashed_vectors(spark.createDataFrame([(1, "Blue plate"), (2, "  BLUE-plate!"), (3, None), (4, "…"), (5, "blue plates"), (6, "crate")], "id long, text string")).collect()}
    cosine = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    assert sorted(got) == [1, 2, 5, 6] and got[1] == got[2] and sum(abs(w) for w in got[6]) <= 6
    assert cosine(got[1], got[5]) > 0.6 > abs(cosine(got[1], got[6]))
