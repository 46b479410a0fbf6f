"""Clustering, the prefix trie and url filters: plain definitions, ties, nulls, empty tables and clashing names."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import clustering, prefix_trie, url_filter
from graphloom.llm.url_filter import Vocabulary, fitting_rule, host_and_path, rules_by_host, terms_of


def test_nearest_is_exact_for_ties_and_near_ties():
    rng = np.random.default_rng(3)
    for scale in (2, 300, 1 << 20, clustering.MOST):
        c = rng.integers(-scale, scale + 1, (40, 64))
        c[7] = c[3]
        x = np.concatenate([rng.integers(-scale, scale + 1, (300, 64)), c[rng.integers(0, 40, 100)], (c[rng.integers(0, 40, 100)] + c[rng.integers(0, 40, 100)]) // 2])
        cluster, distance, exact = clustering.nearest(x, c)
        for row, own, d in zip(x.tolist(), cluster.tolist(), distance.tolist(), strict=True):
            all_of = [sum((a - b) ** 2 for a, b in zip(row, y, strict=True)) for y in c.tolist()]
            assert (d, own) == (min(all_of), all_of.index(min(all_of)))
        assert 0 < exact < len(x)


def lloyd(vectors, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), m in zip(kept, own, strict=True) if m == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i is None, i or 0), *reversed(nearest(v))) for i, v in kept), centroids


def test_clustering_matches_a_plain_one_with_nulls_repeats_and_ties(spark):
    rng = random.Random(5)
    v = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.251]) for _ in range(64)]) for i in range(120)]
    v += [(3, v[3][1]), (None, v[4][1]), (200, None), (201, [0.1] * 63), (202, [None] + [0.0] * 63), (203, [float("nan")] * 64), (204, [float("inf")] * 64), (205, []), (206, v[9][1])]
    df = spark.createDataFrame([(i, x, 0, "x") for i, x in v], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    assigned, centroids = clustering.cluster(df, k=10, rounds=3)
    exact = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in v]
    expected, own = lloyd(exact, 10, 3)
    assert sorted(((r.id is None, r.id or 0), r.cluster, r.distance) for r in assigned.collect()) == expected and centroids.tolist() == own


def test_clustering_of_few_vectors_large_values_and_none(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assigned, centroids = clustering.cluster(df)
    assert len(centroids) == 3 and {r.distance for r in assigned.collect()} == {0}
    assigned, centroids = clustering.cluster(df.limit(0))
    assert assigned.count() == 0 and len(centroids) == 0


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in own.items()}
    again = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:]
    members = {}
    for c, t in again.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = {}
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in m if len(again[c]) == len(path))))
        out[min(m), len(path)] = (min(members[path[:-1]]) if path else None, len(m), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 28), 1000, 1003, 77]:
        if c % 11 == 4:
            continue
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, ""]), rng.choice(["a", "é", "a", None, "", "long " * 9])))
    return rows + rows[:9] + [(None, 1, "user", "lost"), (41, 0, "user", "x" * 20000)] + [(42, t, "user", "same") for t in range(24)] + [(47, t, "user", "same") for t in range(25)]


@pytest.mark.parametrize("local, batch, block", [(1 << 14, 1 << 16, 4096), (40, 25, 4), (0, 1, 2)])
def test_trie_matches_a_plain_one(spark, monkeypatch, local, batch, block):
    monkeypatch.setattr(prefix_trie, "LOCAL_ROWS", local)
    monkeypatch.setattr(prefix_trie, "BATCH_ROWS", batch)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = [r for r in trie_rows(local) if local or r[0] is None or r[0] < 12]  # the deepest large class makes the rounds
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, top string, n int").repartition(3)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(df).collect()}
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).count() == 0
    rows = spark.createDataFrame([(5, 1, b"k" * 16, 3)], "conv long, depth long, key binary, bytes long")
    convs = spark.createDataFrame([(5, 1), (3, 0), (4, 0)], "conv long, length long")
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves) for r in prefix_trie.trie_of(rows, convs).collect()}
    assert got == {(3, 0): (3, 1, 1), (5, 1): (1, 0, 1)}


def test_local_refinement_of_random_classes():
    rng = random.Random(2)
    for _ in range(60):
        tails = {c: [rng.randint(0, 2) for _ in range(rng.randint(0, 5))] for c in rng.sample(range(50), rng.randint(1, 9))}
        rows = [(min(tails), -1, 3, 10, c, 3 + t, k, 0, k + 1) for c, v in sorted(tails.items()) for t, k in [(0, 0), *enumerate(v, 1)]]
        got = prefix_trie.refine_here(*(np.array(x) for x in zip(*rows, strict=True)))
        nodes = {}
        for c, v in tails.items():
            for d in range(len(v) + 1):
                nodes.setdefault(tuple(v[:d]), []).append(c)
        saved = {p: (len(m) - 1) * (p[-1] + 1 if p else 10) for p, m in nodes.items()}
        expected = sorted((min(m), 3 + len(p), len(m), sum(len(q) == len(p) + 1 and q[:-1] == p for q in nodes), sum(saved[q] for q in nodes if q[: len(p)] == p)) for p, m in nodes.items())
        assert sorted(zip(got["conv_id"], got["depth"], got["n"], got["children"], got["saved"], strict=True)) == expected


def test_host_and_path():
    for url, expected in (("", ("", "")), ("no scheme/here", ("", "")), ("HTTP://A.Net", ("a.net", "")), ("x://ÄB.org?q=/y", ("Äb.org", "")), ("a://b/C/d#e?f", ("b", "/C/d")), ("a://b://c/d", ("b:", "//c/d")), ("a://h/x\ny?z", ("h", "/x\ny"))):
        assert host_and_path(url) == expected


def test_rules_by_host_and_path():
    by_host = rules_by_host(url_filter.RULES)
    for host, path, rule in (("a.net", "/x", "net/"), ("net", "/", "net/"), ("net", "", None), ("example.net", "/en/x", "example.net/en/"), ("m.example.net", "/enx", "net/"), ("anet", "/", None), ("example.com", "/de/", "example.com/de/"), ("b.example.com", "/de", None), ("x.org", "/fr/1", "org/fr/"), ("x.net:80", "/", None)):
        assert (fitting_rule(host, path, by_host) or (None,))[0] == rule
    own = rules_by_host((("a.b/", "block"), ("b/xy", "allow"), ("a.b/", "allow")))
    assert fitting_rule("a.b", "/xy", own) == ("a.b/", "block")


def test_terms_stand_between_boundaries():
    v = Vocabulary()
    for url, expected in (("http://casino.x", {"casino"}), ("http://casinos.x", set()), ("http://free-BETS.x/win", {"free", "bets", "win"}), ("http://éporn.x", set()), ("sex", {"sex"}), ("", set()), ("http://sussex.x/sexcam", {"sexcam"})):
        assert terms_of(url, v) == expected
    assert terms_of("casino", Vocabulary((), ())) == set()


def test_url_filter_of_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "h"), (None, "http://a.org/xxx", "h"), (2, "http://cheap.com/pills", "h"), (2, "http://cheap.com/pills", "h"), (3, "http://cheap.com/cheap", "h"), (4, "cheap pills", "h"), (5, "http://q.org/" + "a" * 100000 + "-casino", "h"), (6, "http://xxx.net/", "h"), (7, "http://a.example.net/en/xxx", "h")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert sorted((r.page_id or 0, r.verdict, r.rule or "") for r in got) == [(0, "block", ""), (1, "allow", ""), (2, "block", ""), (2, "block", ""), (3, "allow", ""), (4, "block", ""), (5, "block", ""), (6, "block", "net/"), (7, "allow", "example.net/en/")]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secrets_of_a_text_with_fifty_thousand_values(spark):
    from graphloom.llm.secrets import secrets

    names = [hashlib.md5(b"%d" % k).hexdigest() for k in range(50000)]
    rows = [(1, " ".join(names), "a"), (1, " ".join(names), "a"), (2, "x", "b"), (None, names[0], None)]
    got = secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    long = [r for r in got if r.doc_id == 1]
    assert len(got) == 4 and all(r.n_hex == 50000 and r.n_live > 49000 for r in long) and long[0] == long[1]
    spans = [tuple(map(int, s.split(":")[1:])) for s in long[0].spans.split(",") if s.startswith("hex")]
    assert spans == [(33 * k, 33 * k + 32) for k in range(50000)]


@pytest.mark.parametrize("source", ["a {{ name", "{% set x = name", "{# open", "{{-1}}", "{{- name -}}", "{%- if a %}x{% endif %}", "{{ 'a' }} {{", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{{ " + "not " * 200 + "a }}", "{{ " + "a + " * 400 + "a }}", "{% if a %}" * 60 + "{% endif %}" * 60, "{% if a %}" + "{% elif b %}" * 90 + "{% endif %}"])
def test_what_the_template_language_does_not_have(source):
    from graphloom.llm.template import TemplateError, compile_template

    with pytest.raises(TemplateError):
        compile_template(source)


def test_what_looks_like_marks_and_deep_but_allowed_templates():
    from graphloom.llm.template import compile_template

    deep = "{% if a %}" * 30 + "x" + "{% endif %}" * 30 + "{{ " + "(" * 30 + "b" + ")" * 30 + " }}" + "".join(f"{{% if c == {k} %}}{k}" if not k else f"{{% elif c == {k} %}}{k}" for k in range(30)) + "{% else %}-{% endif %}"
    assert "".join(compile_template(deep)(a=True, b="y", c=7)[0]) == "xy7"
    assert "".join(compile_template("}} %} {a} { {{ '{{ }}' }}")()[0]) == "}} %} {a} { {{ }}"


def test_records_of_other_kinds_are_neither_resolved_nor_served(spark):
    from graphloom.llm.warc import resolve_revisits

    rows = [(1, "response", 0, "aa"), (2, "request", 1, None), (3, "metadata", 2, None), (4, None, 3, None), (5, "revisit", 4, None)]
    df = spark.createDataFrame(rows, "record_id long, kind string, t long, payload_sha256 string").selectExpr("record_id", "kind", "'http://a.org/x' AS url", "timestamp_seconds(1700000000 + t) AS time", "map('etag', 'v', 'content-type', kind) AS headers", "payload_sha256")
    got = {r.record_id: (r.verdict, r.response_id, r.payload_sha256) for r in resolve_revisits(df).collect()}
    assert got == {1: ("full", None, "aa"), 2: ("other", None, None), 3: ("other", None, None), 4: ("other", None, None), 5: ("resolved", 1, "aa")}


def test_conversations_with_ids_of_text(spark):
    from graphloom.llm.chat import format_conversations, read_back

    df = spark.createDataFrame([("b", 0, "user", "hi"), ("a", 1, "assistant", "x"), ("a", 0, "user", None)], "conv_id string, turn long, role string, text string")
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in read_back(format_conversations(df)).collect()) == [("a", 2, 1), ("b", 1, 0)]
