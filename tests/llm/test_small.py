"""The pieces that run in Python alone, held against plain definitions."""

import random

import numpy as np
import pytest

from graphloom.llm.chat import CONTROL, TEMPLATE, escape, read_turns, unescape
from graphloom.llm.mixing import copies, fit
from graphloom.llm.packing import fullest, plan_bins
from graphloom.llm.repeats import LENGTH, repeated_windows
from graphloom.llm.suffix_array import suffix_array, suffix_arrays
from graphloom.llm.template import TemplateError, compile_template, fold, parse
from graphloom.llm.token_files import EliasFano, Shard, pack_shard


def test_suffix_array_sorts_suffixes():
    random.seed(1)
    for _ in range(400):
        s = [random.randint(0, random.choice([0, 1, 3])) for _ in range(random.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_sorts_every_text_on_its_own():
    random.seed(8)
    for _ in range(100):
        texts = [[random.randint(0, random.choice([0, 1, 3, 511])) for _ in range(random.randint(0, 30))] for _ in range(random.randint(0, 6))]
        expected, at = [], 0
        for s in texts:
            expected += [at + i for i in sorted(range(len(s)), key=lambda i: s[i:])]
            at += len(s)
        assert suffix_arrays(np.array(sum(texts, []), int), np.array([len(s) for s in texts], int)).tolist() == expected


def test_elias_fano_round_trip_and_select():
    rng = np.random.default_rng(1)
    for n, step in ((0, 3), (1, 5), (300, 2), (3000, 900)):
        v = np.concatenate([[0], np.cumsum(rng.integers(0, step, n))])
        ef = EliasFano.encode(v)
        assert [ef.select(k) for k in range(len(v))] == v.tolist()


def test_shard_round_trip_with_null_ids():
    arrays = [np.array(a, "<u2") for a in ([1, 2], [], [7] * 50)]
    s = Shard(pack_shard([None, -4, 9], arrays))
    assert s.doc_ids == [None, -4, 9] and [s.document(k).tolist() for k in range(3)] == [a.tolist() for a in arrays]


def test_fullest_is_the_best_subset():
    random.seed(2)
    for _ in range(100):
        counts = {random.randint(1, 12): random.randint(1, 3) for _ in range(4)}
        room = random.randint(0, 30)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        own = fullest(sorted(counts, reverse=True), counts, room)
        assert sum(own) == max(s for s in sums if s <= room) and all(own.count(x) <= counts[x] for x in own)


def test_plan_packs_every_piece_once():
    histogram = {2048: 3, 1000: 7, 24: 20, 1: 5, 512: 9}
    plan = plan_bins(histogram)
    assert {x: sum(p.count(x) * n for p, n in plan) for x in histogram} == histogram and all(sum(p) <= 2048 for p, _ in plan)


def test_fit_meets_the_budget():
    assert sum(x * n for x, n in fit({3: 10, 7: 4, 11: 2}, 41).items()) == 41
    assert fit({}, 5) == {} and fit({0: 3}, 5) == {}


def test_escaping_is_reversible_and_hides_control_strings():
    random.seed(3)
    parts = ["<", "s", ">", "/", "[", "INST", "]", "\\", "SYS", "a", " ", "</s>", "[/INST]", "ROLE", "<<"]
    render = compile_template(TEMPLATE, {"escape": escape})
    for _ in range(300):
        turns = [(random.choice(["user", "assistant", "system", "", "x[ROLE]"]), "".join(random.choices(parts, k=random.randint(0, 9)))) for _ in range(3)]
        assert all(unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL) for _, t in turns)
        text, spans = render(messages=[{"role": r, "text": t} for r, t in turns])
        assert read_turns(text) == turns
        assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_templates_fold_and_stay_in_the_sandbox():
    assert compile_template("{% if 1 == 1 %}a{{ 'b' + 'c' }}{% else %}z{% endif %}")() == ("abc", [])
    assert len(fold(parse("a{{ 'b' }}{% if false %}x{% endif %}c"), {})) == 1
    assert compile_template("{{ x.__class__ }}|{{ x['k'] }}")(x={"k": 1})[0] == "|1"
    for bad in ("{{ f() }}", "{% for x in y %}", "{% import os %}", "{{ 'a' 'b' }}"):
        with pytest.raises(TemplateError):
            compile_template(bad, {})


def test_repeated_windows_stay_within_their_key():
    common = bytes(random.Random(4).choices(range(97, 123), k=240))
    own = [b"x" * 10 + common, b"y" * 10 + common, b"x" * 10 + common, b"z" * 220]
    lengths = np.array([len(x) + 1 for x in own])
    hit = repeated_windows(b"\0".join(own) + b"\0", lengths, lengths - LENGTH, np.array([1, 1, 1, 3]), np.array([5, 5, 6, 7]))
    assert np.flatnonzero(hit).tolist() == [*range(10, 51), *range(251 + 10, 251 + 51), *range(753, 774)]


def test_fit_is_exact_for_documents_longer_than_the_knapsack():
    assert fit({200000: 1, 150000: 2}, 300000) == {200000: 0, 150000: 2}
    random.seed(6)
    for _ in range(60):
        counts = {random.randint(60000, 400000): random.randint(1, 3) for _ in range(5)}
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        budget = random.randint(0, max(sums))
        take = fit(counts, budget)
        assert sum(x * n for x, n in take.items()) == max(s for s in sums if s <= budget) and all(take[x] <= n for x, n in counts.items())


def test_fit_is_exact_with_large_counts_and_a_gap():
    take = fit({1000: 300_000, 1001: 1}, 150_000_500)  # 499 words stay open, whatever is taken
    assert sum(x * n for x, n in take.items()) == 150_000_001
    take = fit({900: 100_000, 1000: 100_000, 999: 3}, 95_000_050)
    assert sum(x * n for x, n in take.items()) == max(s for k in range(4) for s in range(94_990_000 + (999 * k) % 100, 95_000_051, 100))


def test_fit_takes_single_documents_of_all_lengths():
    lengths = range(1000, 3000)
    take = fit(dict.fromkeys(lengths, 1), sum(lengths) // 2)
    assert sum(x * n for x, n in take.items()) == sum(lengths) // 2
    assert 400 < sum(take[x] for x in range(1000, 2000)) < 600


def test_copies_meet_what_up_to_three_of_each_document_can():
    rng = random.Random(1)
    for _ in range(300):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        target = rng.random() * 3 * sum(x * n for x, n in counts.items())
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(3 * n + 1)}
        take = copies(counts, target)
        assert all(0 <= take[x] <= 3 * n for x, n in counts.items())
        assert sum(x * k for x, k in take.items()) == max(s for s in sums if s <= round(target))
    assert copies({}, 5.0) == {} and copies({0: 4}, 0.0) == {}
