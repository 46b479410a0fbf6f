"""URL filters: rules by host and path, and a weighted vocabulary for the urls that no rule fits.

An Aho-Corasick automaton runs over each whole url once, A-Z lower-cased, and reports every term in it, overlaps
included. A term counts where neither neighbour is a word character (0-9, a-z, or anything beyond ASCII). One strict
term rejects; so do ``least_soft`` different soft ones. A rule fits its host and all subdomains if the url's path
starts with the rule's; the longest rule that fits decides, and the vocabulary isn't asked.

Rules and terms are lists that the caller holds, and go to the tasks with the code: nothing is joined or shuffled. A
null url, or one without ``://``, has an empty host and path; its text is still judged by the vocabulary, a null one
as empty. Repeated rows are judged alike, null ids stay null, other columns are ignored, an empty table gives an empty
table. A very long url is one string in one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The contract's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Vocabulary:
    """Terms in lower case. A strict term is enough by itself; of soft ones, ``least_soft`` different ones are needed."""

    strict: tuple[str, ...] = ("casino", "escort", "hentai", "jackpot", "malware", "phishing", "porn", "porno", "sex", "sexcam", "viagra", "warez", "xxx")
    soft: tuple[str, ...] = ("ads", "adult", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "dating", "deal", "deals", "discount", "farm", "free", "gambling", "hot", "keygen", "loan", "loans", "lottery", "pharmacy", "pills", "poker", "pro", "replica", "slots", "spam", "torrent", "track", "tracker", "win", "winner")
    least_soft: int = 2


_HOST = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
JUDGED = "host string, path string, rule string, verdict string, n_strict long, n_soft long, terms array<string>"


def host_and_path(url: str) -> tuple[str, str]:
    at = url.find("://")
    if at < 0:
        return "", ""
    host, path = _HOST.match(url, at + 3).groups()
    return host.translate(_UPPER), path


@lru_cache(4)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _inner(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9" or c > "\x7f"


def terms_of(url: str, vocabulary: Vocabulary) -> set[str]:
    """The different terms of the vocabulary that stand in the url, between boundaries."""
    terms = vocabulary.strict + vocabulary.soft
    low, found = url.translate(_UPPER), set()
    if not terms:
        return found
    for end, term in _automaton(terms).iter(low):
        begin = end + 1 - len(term)
        if term not in found and not (begin and _inner(low[begin - 1])) and not (end + 1 < len(low) and _inner(low[end + 1])):
            found.add(term)
    return found


def rules_by_host(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    """path, rule, verdict of each host's rules, longest path first; of the same rule given twice, the first."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in dict(reversed(rules)).items():
        host, slash, path = rule.partition("/")
        out.setdefault(host.translate(_UPPER), []).append((slash + path, rule, verdict))
    for own in out.values():
        own.sort(key=lambda r: -len(r[0]))
    return out


def fitting_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits, host and path together, and its verdict; of equally long ones, the longer host's."""
    best, at = None, 0
    while True:
        own = next(((rule, verdict) for prefix, rule, verdict in by_host.get(host[at:], ()) if path.startswith(prefix)), None)
        if own and (best is None or len(own[0]) > len(best[0])):
            best = own
        at = host.find(".", at) + 1
        if not at:
            return best


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, vocabulary: Vocabulary = Vocabulary(), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, and the distinct strict and soft terms of every row's url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host, strict = rules_by_host(rules), set(vocabulary.strict)
        for batch in batches:
            rows = []
            for u in batch.column(1).to_pylist():
                u = u or ""
                host, path = host_and_path(u)
                fits, terms = fitting_rule(host, path, by_host) if host else None, terms_of(u, vocabulary)
                hard = len(terms & strict)
                rejected = hard > 0 or len(terms) - hard >= vocabulary.least_soft
                rows.append((host, path, fits[0] if fits else None, fits[1] if fits else "block" if rejected else "allow", hard, len(terms) - hard, sorted(terms)))
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, "host", "path", "rule", "verdict", "n_strict", "n_soft", "terms"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url).mapInArrow(run, f"{key} {kind}, {JUDGED}")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("terms")


def _sql() -> str:
    v = Vocabulary()
    names = lambda terms: ", ".join(f"'{t}'" for t in terms)
    edge = r"[^0-9a-z\x{80}-\x{10FFFF}]"
    held = lambda terms: f"len(list_filter([{names(terms)}], lambda t: regexp_matches(low, '(^|{edge})' || t || '($|{edge})')))"
    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{x}')" for r, x in RULES)
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH r(rule_host, rule_path, rule, verdict) AS (VALUES {rules}),
p AS (SELECT page_id, row_number() OVER () AS row, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, row, {lower('url')} AS low, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
t AS (SELECT *, {held(v.strict)} AS n_strict, {held(v.soft)} AS n_soft FROM q),
f AS (SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN n_strict > 0 OR n_soft >= {v.least_soft} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM t LEFT JOIN f USING (row)
"""


OP13_SQL = _sql()
