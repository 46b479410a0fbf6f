"""Listings, ignore rules, logs, settings, incremental scans, deletion, eviction and undo over small fixtures."""

import pytest

from graphloom.operators.strings import any_filter, apply_filters, filters_from, filters_to
from graphloom.sources import files, repository
from pyspark.sql import functions as F


def paths(spark, *names):
    return spark.createDataFrame([(n, 1) for n in names], "path string, length long")


def test_ignore_rules(spark):
    d = paths(spark, "a.log", "x/a.log", "keep.log", "out/a.py", "x/out/b.py", "docs/c.py", "x/docs/c.py", "a/b/c.tmp", "a/c.tmp")
    lines = ["# no", "", "*.log", "!keep.log", "out/", "/docs", "a/**/*.tmp"]
    assert sorted(r.path for r in d.filter(repository.ignored(F.col("path"), lines)).collect()) == ["a.log", "a/b/c.tmp", "a/c.tmp", "docs/c.py", "out/a.py", "x/a.log", "x/out/b.py"]


def test_discovery_tells_what_it_leaves_out(spark):
    d = paths(spark, "a.py", "b.md", "node_modules/m/i.js", "node_modules/n.js", "web/x.TS", "gen/y.py")
    kept, skipped = repository.discover(d, ["gen/"])
    assert sorted(r.path for r in kept.collect()) == ["a.py", "web/x.TS"]
    assert {(r.reason, r.dir): r.n for r in skipped.collect()} == {("vendored", "node_modules"): 2, ("ignored", "gen"): 1, ("extension", "(root)"): 1}
    assert [tuple(r) for r in repository.vendored_summary(skipped, 2).collect()] == [("node_modules", 2)] and repository.vendored_summary(skipped).isEmpty()
    with pytest.raises(ValueError):
        repository.discover(d, most=2)
    assert [r.path for r in repository.named(paths(spark, "x/package.json", "node_modules/a/package.json"), "package.json").collect()] == ["x/package.json"]


def test_listing_is_relative(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x")
    assert [r.path for r in repository.listing(spark, str(tmp_path)).collect()] == ["d/a.py"]


def test_log_history_carries_headers_over_ranges(spark):
    lines = ["abcdef1|ann|100", "p/a.py", "p/b.py", "", "abcdef2|bob|200", *["p/a.py"] * 2, "q/c.py"]
    for step in (1, 60_000):  # each range holds two lines, then all
        d = spark.createDataFrame([(k * step, x) for k, x in enumerate(lines)], "n long, line string")
        got = {r.path: (r.commits, r.authors, r.last.timestamp()) for r in repository.log_history(d, "p/").collect()}
        assert got == {"a.py": (2, 2, 200.0), "b.py": (1, 1, 100.0)}


def test_settings(spark):
    d = spark.createDataFrame([("web/tsconfig.json", '{\n// c\n"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*", "../lib/*"]}}}')], "path string, content string")
    assert [tuple(r) for r in repository.path_aliases(d).collect()] == [("web", "@/*", ["web/src/*", "web/lib/*"])]
    d = spark.createDataFrame([("package.json", '{"workspaces": ["packages/*"]}'), ("b/package.json", '{"workspaces": {"packages": ["x"]}}')], "path string, content string")
    assert sorted(tuple(r) for r in repository.workspaces(d).collect()) == [("", "packages/*"), ("b", "x")]
    n = repository.nearest(paths(spark, "a/b/c.ts", "z.ts"), spark.createDataFrame([("a",), ("a/b",)], "dir string"))
    assert [tuple(r) for r in n.collect()] == [("a/b/c.ts", "a/b")]
    d = spark.createDataFrame([('{"description": " "}', None, "# T\n\n![x](y)\n\nA *fine* [tool](u) &amp; more.\n\nB"), (None, 'name = "n"\ndescription = "From here"', "x")], "p string, t string, r string")
    assert [r[0] for r in d.select(repository.description(F.col("p"), F.col("t"), F.col("r"))).collect()] == ["A fine tool & more.", "From here"]


def test_incremental_scan(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, sha string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "path string, sha string")
    parse, gone = repository.changes(new, old)
    assert sorted(r.path for r in parse.collect()) == ["b", "d"] and gone.count() == 0
    with pytest.raises(ValueError):
        repository.changes(new.limit(0), old)


def test_whole_graph_and_artifact(spark, tmp_path):
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    e = spark.createDataFrame([(1, 2, "calls")], "src long, dst long, kind string")
    r = spark.createDataFrame([(1, "rrf", 0.5, 1)], "file_id long, scorer string, score double, rank int")
    s = spark.createDataFrame([(2, 3, "class", "C"), (2, 1, "function", "f")], "file_id long, line_start int, kind string, name string")
    g = repository.whole_graph(v, e, r, s)
    got = {x.path: x for x in g.collect()}
    assert [n.name for n in got["b"].names] == ["f", "C"] and got["a"].kinds[0].dst == 2 and got["b"].ranks is None
    files.write_artifact(g, str(tmp_path / "out"), v.filter("id = 2").select("id"))
    lines = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 1 and '"path":"b"' in lines[0] and "ranks" not in lines[0]
    with pytest.raises(ValueError):
        repository.whole_graph(v.drop("path"), e, r, s)


def test_deletion_eviction_undo_backfill(spark):
    t = {"edges": spark.createDataFrame([(1, 5), (2, 5)], "repo long, x int"), "files": spark.createDataFrame([(1, 7)], "repo long, y int")}
    left, audit = files.cascade_delete(t, "repo", spark.createDataFrame([(1,)], "repo long"))
    assert {k: d.count() for k, d in left.items()} == {"edges": 1, "files": 0} and {r.table: r.deleted for r in audit.collect()} == {"edges": 1, "files": 1}
    items = spark.createDataFrame([(1, 40, None, 1), (2, 30, 9, 2), (3, 50, 5, 3)], "id long, size long, used int, added int")
    assert sorted(r.id for r in files.evicted(items, 80).collect()) == [1] and files.evicted(items, 120).count() == 0 and files.evicted(items, 10).count() == 3
    log = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 2, "b"), ("m", 1, 3, None)], "key string, at int, id int, before string")
    assert {r.key: r.value for r in files.undo_latest(log, ["key"]).collect()} == {"k": "b", "m": None}
    a, b = spark.createDataFrame([(1, "x")], "u long, v string"), spark.createDataFrame([("y", 1), ("z", 2), ("z", 2)], "v string, u long")
    once = files.backfilled(a, b, ["u"])
    assert sorted(r.v for r in once.collect()) == ["x", "z"] and files.backfilled(once, b, ["u"]).count() == 2


def test_filter_states(spark):
    address = "segments=a%2Cb&noise=1&q=X&min=0.5"
    state = filters_from(address)
    assert filters_from(filters_to(state)) == state and any_filter(state) and not any_filter(filters_from(""))
    d = spark.createDataFrame([("a/x.py", 0.7), ("a/x.config.js", 0.9), ("c/x.py", 0.9), ("b/y.py", 0.9), ("b/x.ts", 0.1)], "path string, score double")
    assert [r.path for r in apply_filters(d, state).collect()] == ["a/x.py"]
