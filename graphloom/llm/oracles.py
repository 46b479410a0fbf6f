"""DuckDB SQL that says by itself what some of the queries return."""

from __future__ import annotations

from graphloom.llm.chat import CONTROL
from graphloom.llm.quality import LineRules
from graphloom.llm.secrets import ACCESS, ASSIGN, HEX, LEAST_ASSIGNED, Ownership

WORD = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped_length(x: str) -> str:
    """Length of a text in which backslashes and control strings each become two characters."""
    out = f"replace({x}, '\\', '\\\\')"
    for c in sorted(CONTROL, key=len, reverse=True):
        out = f"replace({out}, {_text(c)}, '\\a')"
    return f"length({out})"


OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {_escaped_length('text')} + 7 + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 0 WHEN 'system' THEN 15 ELSE 13 + {_escaped_length('role')} END AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def _matches(kind: int, pattern: str) -> str:
    return f"""SELECT doc_id, source, {kind} AS kind, generate_subscripts(m, 1) AS i, unnest(m) AS match, unnest(p[1:len(m)]) AS piece FROM (SELECT doc_id, source, regexp_extract_all(t, {_text(pattern)}) AS m, regexp_split_to_array(t, {_text(pattern)}) AS p FROM d)"""


_RULES = Ownership()
_SEEN = f"len(list_distinct(string_split(value, ''))) >= {_RULES.least_distinct} AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= {_RULES.least_digits} AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= {_RULES.least_letters} AND NOT regexp_matches(value, {_text(_RULES.placeholders)})"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({_matches(0, ASSIGN)} UNION ALL {_matches(1, ACCESS)} UNION ALL {_matches(2, HEX)}),
s AS (SELECT doc_id, source, kind, match, CAST(sum(length(piece)) OVER w + sum(length(match)) OVER w - length(match) AS BIGINT) AS a, CASE kind WHEN 0 THEN regexp_extract(match, {_text(ASSIGN)}, 2) ELSE match END AS value FROM m WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
b AS (SELECT doc_id, source, kind, a, a + length(match) AS e, value, {_SEEN} AS random FROM s WHERE kind > 0 OR length(value) >= {LEAST_ASSIGNED}),
o AS (SELECT value, count(DISTINCT (doc_id, source)) AS repositories, count(DISTINCT coalesce(source, chr(0))) AS owners, bool_or(random) AS random FROM b GROUP BY 1),
v AS (SELECT value, owners, CASE WHEN owners >= {_RULES.example_owners} OR repositories >= {_RULES.example_repositories} THEN 'example' WHEN owners = 1 AND random THEN 'live' END AS verdict FROM o),
x AS (SELECT b.*, v.verdict, v.owners FROM b JOIN v USING (value)),
al AS (SELECT doc_id, kind, a, e FROM x UNION ALL SELECT doc_id, 3, a, e FROM x WHERE verdict = 'live'),
g AS (SELECT doc_id, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans, string_agg(['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || e, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
  count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind = 3) AS n3 FROM al GROUP BY 1),
y AS (SELECT doc_id, count(*) FILTER (verdict = 'example') AS n_example, max(owners) FILTER (verdict IS NOT NULL) AS most_owners FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n3, 0) AS INTEGER) AS n_live, CAST(coalesce(n_example, 0) AS INTEGER) AS n_example, coalesce(most_owners, 0) AS most_owners
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN y USING (doc_id)
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS x FROM documents UNION SELECT e.b, r.x FROM r JOIN e ON e.a = r.id WHERE r.x < e.b)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, k.x AS component_id, d.doc_id = k.x AS kept FROM documents d LEFT JOIN c USING (doc_id) JOIN (SELECT id, min(x) AS x FROM r GROUP BY 1) k ON k.id = d.doc_id
"""

_LINE = LineRules()
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), range(0, 8) r(o) GROUP BY 1),
ln AS (SELECT doc_id, x, len(regexp_extract_all(x, '{WORD}')) AS n, len(regexp_extract_all(x, {_text(_LINE.separators)})) AS sep, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS sym FROM (SELECT doc_id, unnest(l) AS x FROM w)),
jd AS (SELECT doc_id, length(x) AS size, (NOT regexp_matches(x, {_text(_LINE.ends)}) AND n < {_LINE.bare_words}) OR sym * 100 > length(x) * {_LINE.symbol_percent} OR (regexp_matches(x, {_text(_LINE.separators)}) AND sep >= {_LINE.navigation} AND n <= {_LINE.entry_words} * (sep + 1) + sep)
  OR (regexp_matches(x, {_text(_LINE.boilerplate)}) AND n < {_LINE.boilerplate_words}) AS bad FROM ln),
js AS (SELECT doc_id, sum(size) AS line_chars, count(*) FILTER (NOT bad) AS n_kept_lines, coalesce(sum(size) FILTER (NOT bad), 0) AS kept_chars FROM jd GROUP BY 1),
f AS (SELECT w.doc_id, len(w) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, CAST(len(l) AS INTEGER) AS n_lines,
  CAST(coalesce(n_kept_lines, 0) AS INTEGER) AS n_kept_lines, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN js USING (doc_id))
SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND NOT (line_chars - kept_chars) * 100 > line_chars * {_LINE.most_lost_percent} AS kept FROM f
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
t AS (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM w JOIN t USING (k) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r) GROUP BY doc_id, g),
p AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
q AS (SELECT p.doc_id, sum(e - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)
"""
