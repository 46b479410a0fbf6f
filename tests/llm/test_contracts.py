"""Every contract column of the queries that SQL can't say, held against plain definitions over a whole table; and hard inputs."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import chat, exact_dedup, minhash, mixing, quality, secrets, warc
from graphloom.llm.queries import QUERIES
from graphloom.llm.template import TemplateError, compile_template
from graphloom.llm.tokens import vocabulary_path
from tests.conftest import SF


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def tokens(documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    return {d: plain.encode(t, add_special_tokens=False).ids for d, t, _ in documents}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op5_against_the_tokenizer(spark, documents, tokens):
    at, expected = 0, {}
    for d, _, _ in documents:
        ids = [*tokens[d], 1]
        expected[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_shards"](spark, SF).collect()} == expected


def test_op9_against_the_tokenizer(spark, tokens):
    expected = {}
    for d, ids in tokens.items():
        ids = [*ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[d, piece] = (start, len(part), crc(part))
    got = QUERIES["op9_slack_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    bound = math.ceil(sum(r.length for r in got) / 2048)
    assert bound <= len(bins) <= bound + 1


def water_level(sizes, weights):
    """Shares by weight, capped at three times each size, by taking the most capped one after another."""
    total, left, target = sum(sizes), dict(enumerate(sizes)), {}
    share = float(total)
    while True:
        own = {k: share * weights[k] / sum(weights[j] for j in left) for k in left}
        over = [k for k in left if own[k] > 3 * sizes[k] + 1e-9]
        if not over:
            return [target.get(k, own.get(k)) for k in range(len(sizes))]
        for k in over:
            target[k] = 3.0 * sizes[k]
            share -= target[k]
            del left[k]


def test_op6_targets_and_closeness(spark, documents):
    sizes = collections.Counter()
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t, _ in documents}
    for d, _, s in documents:
        sizes[s] += words[d]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = dict(zip(order, water_level([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    got = QUERIES["op6_budget_mix"](spark, SF).collect()
    source = {d: s for d, _, s in documents}
    assert all(r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(expected[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(documents)
    for s in order:
        shortest = min(r.size for r in got if source[r.doc_id] == s and r.size)
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - expected[s]) <= max(1, shortest)
    again = {r.doc_id: r.taken for r in QUERIES["op6_budget_mix"](spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in got}


@pytest.mark.parametrize("sizes", [[100, 1, 1], [5, 5000, 5, 5, 1], [1, 1, 1, 1000, 1, 1, 1], [7]])
def test_capped_shares(spark, sizes):
    rows = [(k, f"s{k}", " ".join(["w"] * n)) for k, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).select("source", "target").distinct().collect()}
    expected = water_level(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
    assert [got[f"s{k}"] for k in range(len(sizes))] == pytest.approx(expected)


NAMES = "__k", "__q", "__sha", "__id", "__hash", "__len", "__pre", "__text_hash", "__doc_id", "__times", "__copy", "row", "k", "q", "hash", "len", "pre", "hit", "copy", "times", "text_hash", "a.b"
TEXT = "\n".join(" ".join(f"w{i}{j}" for j in range(14)) + "." for i in range(6))


def clashing(spark):
    """Two rows alike and one other, with columns of every name used inside."""
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(d, t, "s", len(t), *(f"{n}-{d}" for n in NAMES)) for d, t in ((1, TEXT), (1, TEXT), (2, TEXT.replace("w00", "other")))]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("stage, left", [(quality.clean_documents, 3), (exact_dedup.keep_exact, 2), (minhash.keep_near, 1), (mixing.mixed_documents, None)])
def test_columns_of_clashing_names_keep_their_values(spark, stage, left):
    docs = clashing(spark)
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and (left is None or len(rows) == left)
    assert all(r[f"{n}"] == f"{n}-{r.doc_id}" for r in rows for n in NAMES)


def test_null_ids_do_not_multiply_texts(spark, monkeypatch):
    texts = [" ".join(f"{g}{i}" if i != k else "changed" for i in range(100)) for g in "abcdefghij" for k in (300, 5, 50)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(7, texts[0])] * 3, "doc_id long, text string")
    sizes = []
    monkeypatch.setattr(minhash, "sets_of", lambda d, real=minhash.sets_of: sizes.append(d.count()) or real(d))
    got = minhash.near_duplicates(docs).collect()
    assert sizes[0] <= len(texts) + 3 and len(got) == len(texts) + 3
    assert {r.component_id for r in got} == {None, 7}


def scanned(text):
    """Base spans by the contract's own words."""
    found = []
    for k, (kind, pattern, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16))):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [s for _, _, s in sorted(found)]


def test_secrets_against_the_contract(spark):
    log = "\n".join(f"{i:032x} é token={i * 7919:020x} AKIA{i:016d}" for i in range(700))
    texts = [None, "", log, "password: short", 'API_KEY = "abcdefghijkl"', "AKIA" + "A" * 13, "AKIA" + "A" * 14, "f" * 15, "f" * 16, "Secret:" + "a" * 12 + " Token='x" + "y" * 30 + "'", "passwdsecret=" + "z" * 20]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secrets.secrets(docs).collect():
        base = scanned(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == base
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_ownership_tells_examples_from_live_values(spark):
    live, example = "token=aB3dE5fG7hJ9kL2m", "secret=Zx8cV6bN4mQ2wE1r"
    rows = [(0, live, "a"), (1, live, "a")] + [(10 + i, example, f"owner{i % 4}") for i in range(8)]
    got = {r.doc_id: (r.n_live, r.n_example, r.most_owners) for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == got[1] == (1, 0, 1) and got[10] == (0, 1, 4)


def revisits(spark, rows):
    d = spark.createDataFrame(rows, "record_id long, kind string, url string, time long, headers map<string,string>, payload_sha256 string")
    d = d.withColumn("time", d.time.cast("timestamp"))
    return {r.record_id: r for r in warc.resolve_revisits(d, 100).collect()}


def test_revisits(spark):
    got = revisits(spark, [
        (1, "response", "http://H:80/a/?b=1&utm_x=2&a=0#f", 10, {"ETag": 'W/"q"', "Content-Type": "t"}, "one"),
        (2, "revisit", "http://h/a?a=0&b=1", 20, {"etag": '"q"', "Expires": "e", "content-type": "no"}, None),
        (3, "revisit", "http://h/a?a=0&b=1", 20, {"etag": '"zz"'}, None),
        (4, "revisit", "http://h/a?a=0&b=1", 10, {"etag": '"q"'}, None),
        (5, "revisit", "http://h/a?a=0&b=1", 950, {"Expires": "late"}, None),
        (6, "response", "http://h/a?a=0&b=1", 20, {"x": "y"}, "two"),
        (7, "revisit", "http://h:443/a?a=0&b=1", 30, None, None),
        (8, "response", "https://h:443/z", 1, None, "s"), (9, "revisit", "https://h/z", 2, {"A": "1", "a": "2"}, None),
    ])
    assert {k: r.verdict for k, r in got.items()} == {1: "full", 2: "resolved", 3: "mismatch", 4: "no_response", 5: "unchecked", 6: "full", 7: "no_response", 8: "full", 9: "unchecked"}
    assert got[2].headers == {"etag": '"q"', "content-type": "t", "expires": "e"} and got[2].payload_sha256 == "one" and got[2].check == "etag"
    assert got[5].response_id == 6 and got[5].payload_sha256 == "two" and got[9].headers == {} and got[3].payload_sha256 is None


def test_a_hot_url_with_equal_times(spark):
    rows = [(k, "response" if k % 3 == 0 else "revisit", "http://h/", k // 6 * 40, {"etag": f'"{k // 30}"'}, f"p{k}" if k % 3 == 0 else None) for k in range(120)]
    got = revisits(spark, rows)
    for k, kind, _, time, headers, _ in rows:
        if kind == "revisit":
            before = [r for r in rows if r[1] == "response" and r[3] < time]
            last = max(before, key=lambda r: (r[3], r[0]), default=None)
            expected = "no_response" if last is None else "resolved" if last[4] == headers else "mismatch"
            assert (got[k].verdict, got[k].response_id) == (expected, last and last[0])


def test_templates_tell_their_own_errors():
    for bad in ("{{ 'a' < 1 }}", "{{ 1 in 2 }}", "{{ 3 | length }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    for late, value in (("{{ x < 1 }}", {"x": "a"}), ("{% for y in x %}{% endfor %}", {"x": 5}), ("{% for y in x %}{% endfor %}", {"x": "text"})):
        with pytest.raises(TemplateError):
            compile_template(late)(**value)
    assert compile_template("{{ '}}' }}{{ \"%}\" }}{% if x == '%}' %}y{% endif %}")(x="%}")[0] == "}}%}y"
    assert compile_template("{{ x }}{% for y in x %}n{% endfor %}")(x=None)[0] == ""


def test_chat_with_hard_texts(spark):
    texts = ["\\a</s>\\", "[INST] <s>", None, "", "x" * 200_000, "</s>" * 1000, "é\u2028\r\n"]
    roles = ["user", "assistant", "system", "tool", None, "[ROLE]x", "assistant"]
    rows = [(c, k, roles[(c + k) % 7], texts[(c * 3 + k) % 7]) for c in range(7) for k in range(7)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(7):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        learnt = "".join(t for r, t in own if r == "assistant")
        assert got[c].n_turns == 7 and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_chars == len(learnt) and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_empty_tables_through_every_query(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name.startswith("op2_") else 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    from graphloom.llm.common import shared_dir

    class Nothing:
        def __getattr__(self, name):
            return lambda *a, **k: None if name == "get" else False if name == "isDefined" else self

    class Context(Nothing):
        master = "spark://host:7077"
        _jsc = Nothing()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
