"""Timed words of talks, and documents by sections: rates, pauses, fillers, buckets; headers, spans, qualifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.registry import query
from graphloom.session import table

# Words that fill and words that may be crutches, the least pause, seconds of a bucket.
FILLERS = ("um", "uh", "erm", "ah", "hmm", "mmm", "uhm")
CRUTCHES = ("like", "basically", "actually", "literally", "so", "right", "okay", "just")
PAUSE, BUCKET = 0.6, 10
#: Seconds of the words of a conversation: 0.4 each, 0.3 of them spoken; a second more after the end of a sentence.
WORDS_SQL = """tw AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE text IS NOT NULL),
sq AS (SELECT conv_id, w, row_number() OVER o - 1 AS k, coalesce(count(*) FILTER (regexp_matches(w, '[.!?]$')) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM tw WINDOW o AS (PARTITION BY conv_id ORDER BY turn, i)),
words AS (SELECT conv_id, w, k, (4 * k + 10 * stops) / 10.0 AS a, (4 * k + 10 * stops + 3) / 10.0 AS b, CASE WHEN k % 41 = 7 THEN 'um' WHEN k % 29 = 3 THEN 'like' WHEN k % 53 = 11 THEN 'you' WHEN k % 53 = 12 THEN 'know' ELSE regexp_replace(lower(w), '[^0-9A-Za-z_'']', '', 'g') END AS c FROM sq)"""


def timed_words(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, k, w, a, b (seconds from and to), c (the cleaned word, fillers mixed in): every word of every talk."""
    t = table(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("i", "w"))
    own = W.partitionBy("conv_id").orderBy("turn", "i")
    stop = F.when(F.col("w").rlike("[.!?]$"), 1).otherwise(0)
    t = t.withColumn("k", F.row_number().over(own) - 1).withColumn("stops", F.coalesce(F.sum(stop).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at, k = 4 * F.col("k") + 10 * F.col("stops"), F.col("k")
    c = F.when(k % 41 == 7, "um").when(k % 29 == 3, "like").when(k % 53 == 11, "you").when(k % 53 == 12, "know").otherwise(F.regexp_replace(F.lower("w"), r"[^0-9A-Za-z_']", ""))
    return t.select("conv_id", "k", "w", (at / 10).alias("a"), ((at + 3) / 10).alias("b"), c.alias("c"))


@query("txt_word_timing", f"""WITH {WORDS_SQL}, n AS (SELECT *, lead(c) OVER (PARTITION BY conv_id ORDER BY k) AS nx FROM words), m AS (SELECT conv_id, count(*) AS n, max(b) - min(a) AS d, count(*) FILTER (c IN {FILLERS}) AS f, count(*) FILTER (c = 'you' AND nx = 'know') AS y, sum(b - a) AS spoken FROM n GROUP BY 1)
SELECT conv_id, n AS n_words, round(CAST(d AS DOUBLE), 6) AS duration, CAST(round_even(CAST(n AS DOUBLE) / greatest(CAST(d AS DOUBLE), 1.0) * 60, 0) AS BIGINT) AS wpm, f + y AS fillers, y AS you_know, round((f + y) / greatest(CAST(d AS DOUBLE) / 60, .1), 6) AS filler_rate, round(least(1.0, CAST(spoken AS DOUBLE) / greatest(CAST(d AS DOUBLE), .1)), 6) AS talk_ratio FROM m""")
def word_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Words a minute, fillers with the pair 'you know', their rate over a tenth of a minute at least, and the share of time spoken."""
    w = timed_words(spark, sf).withColumn("nx", F.lead("c").over(W.partitionBy("conv_id").orderBy("k")))
    m = w.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), (F.max("b") - F.min("a")).alias("d"), F.count_if(F.col("c").isin(*FILLERS)).alias("f"), F.count_if((F.col("c") == "you") & (F.col("nx") == "know")).alias("y"), F.sum(F.col("b") - F.col("a")).alias("s"))
    wpm = F.bround(F.col("n") / F.greatest("d", F.lit(1.0)) * 60).cast("long")
    return m.select("conv_id", F.col("n").alias("n_words"), F.round("d", 6).alias("duration"), wpm.alias("wpm"), (F.col("f") + F.col("y")).alias("fillers"), F.col("y").alias("you_know"), F.round((F.col("f") + F.col("y")) / F.greatest(F.col("d") / 60, F.lit(0.1)), 6).alias("filler_rate"), F.round(F.least(F.lit(1.0), F.col("s") / F.greatest("d", F.lit(0.1))), 6).alias("talk_ratio"))


@query("txt_pauses", f"WITH {WORDS_SQL}, g AS (SELECT conv_id, w, lead(a) OVER (PARTITION BY conv_id ORDER BY k) - b AS gap FROM words) SELECT conv_id, count(*) FILTER (gap > .6) AS pauses, count(*) FILTER (gap > .6 AND regexp_matches(w, '[.!?]$')) AS rhetorical, count(*) FILTER (gap > .6 AND NOT regexp_matches(w, '[.!?]$')) AS stalls, coalesce(round(CAST(max(gap) FILTER (gap > .6) AS DOUBLE), 1), 0) AS longest FROM g GROUP BY 1")
def pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between words: those after the end of a sentence are rhetorical, others stall."""
    gap = F.round(F.lead("a").over(W.partitionBy("conv_id").orderBy("k")) - F.col("b"), 6)
    g = timed_words(spark, sf).select("conv_id", gap.alias("gap"), F.col("w").rlike("[.!?]$").alias("end"))
    long = F.col("gap") > PAUSE
    return g.groupBy("conv_id").agg(F.count_if(long).alias("pauses"), F.count_if(long & F.col("end")).alias("rhetorical"), F.count_if(long & ~F.col("end")).alias("stalls"), F.coalesce(F.round(F.max(F.when(long, F.col("gap"))), 1), F.lit(0.0)).alias("longest"))


@query("txt_pace", f"WITH {WORDS_SQL}, b AS (SELECT conv_id, CAST(floor((a - min(a) OVER (PARTITION BY conv_id)) / 10) AS BIGINT) AS bucket FROM words), n AS (SELECT conv_id, bucket, count(*) AS n FROM b GROUP BY 1, 2), g AS (SELECT conv_id, unnest(range(0, max(bucket) + 1)) AS bucket FROM n GROUP BY 1) SELECT g.conv_id, g.bucket * 10 AS t, coalesce(n, 0) * 6 AS wpm, n IS NOT NULL AS in_sparse FROM g LEFT JOIN n USING (conv_id, bucket)")
def pace(spark: SparkSession, sf: str) -> DataFrame:
    """Words a minute by ten seconds, with zeros between; the sparse form has the rows of buckets that hold a word."""
    w = timed_words(spark, sf)
    first = w.groupBy("conv_id").agg(F.min("a").alias("t0"))
    n = w.join(first, "conv_id").groupBy("conv_id", F.floor((F.col("a") - F.col("t0")) / BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = n.groupBy("conv_id").agg(F.max("bucket").alias("most")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("bucket"))
    return grid.join(n, ["conv_id", "bucket"], "left").select("conv_id", (F.col("bucket") * BUCKET).alias("t"), (F.coalesce("n", F.lit(0)) * 6).alias("wpm"), F.col("n").isNotNull().alias("in_sparse"))


@query("txt_crutches", f"WITH {WORDS_SQL}, c AS (SELECT conv_id, c AS word, count(*) AS n FROM words WHERE c IN {CRUTCHES} GROUP BY 1, 2 HAVING count(*) >= 3) SELECT conv_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) <= 5")
def crutches(spark: SparkSession, sf: str) -> DataFrame:
    """The words of a list that a talk leans on: three times or more, the five most frequent."""
    c = timed_words(spark, sf).filter(F.col("c").isin(*CRUTCHES)).groupBy("conv_id", F.col("c").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return c.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "word"))).filter("k <= 5").drop("k")


@query("txt_longest_clean", f"WITH {WORDS_SQL}, p AS (SELECT conv_id, a FROM words WHERE c IN {FILLERS} UNION ALL SELECT conv_id, min(a) FROM words GROUP BY 1 UNION ALL SELECT conv_id, max(a) FROM words GROUP BY 1), g AS (SELECT conv_id, a - lag(a) OVER (PARTITION BY conv_id ORDER BY a) AS gap FROM p) SELECT conv_id, round(CAST(max(gap) AS DOUBLE), 1) AS secs FROM g GROUP BY 1")
def longest_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The longest stretch without a filler, from the first word's start to the last one's."""
    w = timed_words(spark, sf)
    ends = w.groupBy("conv_id").agg(F.min("a").alias("x"), F.max("a").alias("y")).select("conv_id", F.explode(F.array("x", "y")).alias("a"))
    p = w.filter(F.col("c").isin(*FILLERS)).select("conv_id", "a").unionByName(ends)
    g = p.select("conv_id", (F.col("a") - F.lag("a").over(W.partitionBy("conv_id").orderBy("a"))).alias("gap"))
    return g.groupBy("conv_id").agg(F.round(F.max("gap"), 1).alias("secs"))


@query("txt_blended_score", "SELECT event_id, round(CAST(.5 * (event_id % 101) + .3 * (event_id % 67) + .2 * (event_id % 31) AS DOUBLE), 6) AS overall FROM events")
def blended(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluated parts in fixed shares."""
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(0.5 * (e % 101) + 0.3 * (e % 67) + 0.2 * (e % 31), 6).alias("overall"))


# What headers of a posting say, the longest header, the most that may follow a phrase, weights of sections,
# bonuses, tiers from the strongest with their phrases, and how far before a name they count.
SECTIONS = {
    "required": ("requirements", "required", "required qualifications", "minimum qualifications", "must have", "what you'll need", "qualifications", "who you are"),
    "preferred": ("preferred", "preferred qualifications", "desired"),
    "nice_to_have": ("nice to have", "bonus points", "good to have"),
    "responsibilities": ("responsibilities", "what you'll do", "about the role", "your role"),
    "boilerplate": ("about us", "benefits", "perks", "how to apply", "our values"),
}
LONGEST_HEADER, SLACK, LOOKBACK = 80, 14, 160
SECTION_BASE = {"required": 0.60, "responsibilities": 0.42, "preferred": 0.24, "nice_to_have": 0.18, "boilerplate": 0.03, "unknown": 0.30}
TIERS = {"expert": ("expert", "expertise in", "deep experience"), "proficient": ("5+ years", "strong", "advanced", "proven"), "working": ("experience with", "hands-on", "ability to"), "awareness": ("familiar with", "exposure to", "a plus", "basic")}
QUALIFIER = {"expert": 0.15, "proficient": 0.08, "working": 0.0, "awareness": -0.12}
ALIASES = {"Kubernetes": ("k8s", "kube"), "Machine Learning": ("ml", "statistical learning"), "SQL": ("sql queries", "relational databases"), "Python": ("python3", "python programming")}
SURFACES = ("Kubernetes", "k8s", "machine learning", "ML", "SQL queries", "SQL", "Python", "python3", "data pipelines", "pipelines")


def skill_form(name: Column) -> Column:
    """Lower case for case folding, [a-z0-9+#/. ] alone, single spaces, plurals of words of over three letters without their s."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9+#/. ]+", " "), r"\s+", " "))
    return F.array_join(F.transform(F.split(kept, " "), lambda t: F.when(t.rlike("^[a-z]{4,}$") & F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)), " ")


POSTING_SQL = """postings AS (SELECT c_custkey AS id, 'Senior ' || ['SQL', 'Python', 'Kubernetes'][c_custkey % 3 + 1] || ' Engineer' AS title, 'We are ' || c_name || '.' || chr(10) || '## Requirements:' || chr(10) || '- Expert in SQL queries and k8s' || chr(10) || '- python3, familiar with ' || ['data pipelines', 'ML', 'machine learning'][c_custkey % 3 + 1] || chr(10) || '**Nice to have** -' || chr(10) || 'Some SQL; strong Python. Kubernetes' || chr(10) || ['What you''ll do:', 'Perks and more', 'Preferred'][c_custkey % 4 % 3 + 1] || chr(10) || 'Build pipelines with ' || c_mktsegment || '.' AS text FROM customer)"""


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """id, title, text of a posting for each customer."""
    k = F.col("c_custkey")
    pick = lambda n, *options: F.get(F.array(*map(F.lit, options)), n.cast("int"))
    lines = (F.concat(F.lit("We are "), "c_name", F.lit(".")), F.lit("## Requirements:"), F.lit("- Expert in SQL queries and k8s"), F.concat(F.lit("- python3, familiar with "), pick(k % 3, "data pipelines", "ML", "machine learning")), F.lit("**Nice to have** -"), F.lit("Some SQL; strong Python. Kubernetes"), pick(k % 4 % 3, "What you'll do:", "Perks and more", "Preferred"), F.concat(F.lit("Build pipelines with "), "c_mktsegment", F.lit(".")))
    return table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("Senior "), pick(k % 3, "SQL", "Python", "Kubernetes"), F.lit(" Engineer")).alias("title"), F.concat_ws("\n", *lines).alias("text"))


def header_label(line: Column) -> Column:
    """The section that a line names, null if none: decoration goes, an exact phrase beats the longest one it starts with; of equal ones the first in the list."""
    bare = F.regexp_replace(F.regexp_replace(line, r"^[\s#*\-•‣◦⁃∙\d.)(\[\]:>]+", ""), r"[\s:\-–—*]+$", "")
    c = F.lower(F.regexp_replace(bare, r"\s+", " "))
    listed = [(p, label) for label, phrases in SECTIONS.items() for p in phrases]
    options = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("place"), F.lit(label).alias("label")) for k, (p, label) in enumerate(listed)))
    fits = F.filter(options, lambda o: (c == o["phrase"]) | (F.startswith(c, o["phrase"]) & (F.length(c) - F.length(o["phrase"]) <= SLACK)))
    best = F.array_min(F.transform(fits, lambda o: F.struct((c != o["phrase"]).alias("longer"), (-F.length(o["phrase"])).alias("size"), o["place"].alias("place"), o["label"].alias("label"))))
    return F.when((c != "") & (F.length(c) <= LONGEST_HEADER), best["label"])


def sections(docs: DataFrame) -> DataFrame:
    """id, label, start, end (code points, end exclusive) of every section of texts (id, text); a text without header is one unknown section."""
    lines = docs.select("id", F.length("text").alias("size"), F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    own = W.partitionBy("id").orderBy("k")
    at = F.coalesce(F.sum(F.length("line") + 1).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marks = lines.withColumn("start", at).withColumn("label", header_label(F.col("line")))
    heads = marks.filter("label is not null or k = 0").select("id", "size", "start", F.coalesce("label", F.lit("unknown")).alias("label"))
    end = F.coalesce(F.lead("start").over(W.partitionBy("id").orderBy("start")), F.col("size"))
    return heads.select("id", "label", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"))


PHRASES_SQL = "ph(phrase, label, place) AS (VALUES " + ", ".join(f"('{p.replace(chr(39), chr(39) * 2)}', '{s}', {k})" for k, (s, p) in enumerate((s, p) for s, ps in SECTIONS.items() for p in ps)) + ")"
SECTIONS_SQL = f"""{POSTING_SQL}, {PHRASES_SQL}, ln AS (SELECT id, length(text) AS size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM postings),
lc AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lower(regexp_replace(regexp_replace(line, '^[\\s#*\\-•‣◦⁃∙0-9.)(\\[\\]:>]+', ''), '[\\s:\\-–—*]+$', '')) AS c FROM ln),
lb AS (SELECT id, size, k, start, (SELECT arg_min(label, (c <> phrase, -length(phrase), place)) FROM ph WHERE c = phrase OR (starts_with(c, phrase) AND length(c) - length(phrase) <= {SLACK})) AS label FROM lc),
sec AS (SELECT id, coalesce(label, 'unknown') AS label, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY id ORDER BY start), size) AS BIGINT) AS "end" FROM lb WHERE label IS NOT NULL OR k = 1)"""


@query("txt_sections", f'WITH {SECTIONS_SQL} SELECT id, label, start, "end" FROM sec')
def sections_query(spark: SparkSession, sf: str) -> DataFrame:
    return sections(postings(spark, sf))


def name_pattern() -> str:
    """Names of the list as whole words, longer ones first."""
    names = sorted({s.lower() for s in SURFACES}, key=lambda s: (-len(s), s))
    return r"(?i)(?<![\w+#])(?:" + "|".join(n.replace("+", r"\+") for n in names) + r")(?![\w+#])"


def canonical(surface: Column) -> Column:
    """The name that an alias stands for, else the name itself in small letters."""
    known = {**{a: c for c, forms in ALIASES.items() for a in forms}, **{c.lower(): c for c in ALIASES}}
    alias = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))
    return F.coalesce(F.try_element_at(alias, F.lower(surface)), F.lower(surface))


def mentions(docs: DataFrame) -> DataFrame:
    """id, surface, offset, canonical, section: where names of a list stand as whole words in each text, told by text and
    place; an alias stands for its name, and a name inside a longer one at the same place doesn't count."""
    pattern = name_pattern()
    found = docs.select("id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"), F.split("text", pattern).alias("p"))
    pairs = found.select("id", F.posexplode(F.zip_with("m", F.slice("p", F.lit(1), F.size("m")), lambda a, b: F.struct(a.alias("surface"), F.length(b).alias("gap")))).alias("k", "x"))
    own = W.partitionBy("id").orderBy("k")
    at = F.sum(F.col("x.gap")).over(own.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("x.surface")).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = pairs.select("id", F.col("x.surface").alias("surface"), at.alias("offset")).withColumn("canonical", canonical(F.col("surface")))
    s = sections(docs).groupBy("id").agg(F.collect_list(F.struct("start", "end", "label")).alias("s"))
    label = F.try_element_at(F.filter("s", lambda x: (x["start"] <= F.col("offset")) & (x["end"] > F.col("offset"))), F.lit(1))["label"]
    return m.join(s, "id").select("id", "surface", "offset", "canonical", F.coalesce(label, F.lit("unknown")).alias("section"))


def qualifier(text: Column, offset: Column) -> Column:
    """The strongest tier whose phrase stands in the sentence before a place, within so many characters."""
    window = F.substring(text, F.greatest(offset - LOOKBACK, F.lit(0)) + 1, F.least(offset, F.lit(LOOKBACK)))
    sentence = F.lower(F.regexp_replace(window, r"(?s)^.*[.!?\n•;]", ""))
    has = lambda tier: F.exists(F.array(*map(F.lit, TIERS[tier])), lambda p: F.contains(sentence, p))
    return F.when(has("expert"), "expert").when(has("proficient"), "proficient").when(has("working"), "working").when(has("awareness"), "awareness").otherwise("working")


def weights(docs: DataFrame) -> DataFrame:
    """id, canonical, weight and what it is made of: strongest section, in the title, repeated, early, qualified."""
    m = mentions(docs).join(docs, "id")
    base = F.create_map(*(F.lit(v) for kv in SECTION_BASE.items() for v in kv))
    tier = qualifier(F.col("text"), F.col("offset"))
    rank = F.array_position(F.array(*map(F.lit, TIERS)), tier)
    g = m.groupBy("id", "canonical").agg(F.max(base[F.col("section")]).alias("section_base"), F.countDistinct("offset", "surface").alias("n"), F.min("offset").alias("first"), F.first("title").alias("title"), F.max(F.length("text")).alias("size"), F.min(rank).alias("rank"))
    title = F.split(skill_form(F.col("title")), " ")
    inside = F.when(F.size(F.array_except(F.split(skill_form(F.col("canonical")), " "), title)) == 0, 0.25).otherwise(0.0)
    repeated = F.least(F.lit(0.18), 0.09 * F.log2(F.greatest(F.lit(1), F.col("n")).cast("double")))
    early = 0.10 * (1 - F.col("first") / F.greatest("size", F.lit(1)))
    bonus = F.get(F.array(*map(F.lit, QUALIFIER.values())), (F.col("rank") - 1).cast("int"))
    w = g.select("id", "canonical", "section_base", inside.alias("title_bonus"), repeated.alias("repetition"), early.alias("position"), bonus.alias("qualifier"), "n")
    raw = sum((F.col(c) for c in ("title_bonus", "repetition", "position", "qualifier")), F.col("section_base"))
    return w.withColumn("weight", F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw)))


CANON_SQL = "CASE lower(surface) " + " ".join(f"WHEN '{f}' THEN '{c}'" for c, forms in ALIASES.items() for f in (c.lower(), *forms)) + " ELSE lower(surface) END"
MENTION_PATTERN = "(?i)(?:" + "|".join(sorted({s.lower() for s in SURFACES}, key=lambda s: (-len(s), s))) + ")"
MENTIONS_SQL = f"""{SECTIONS_SQL}, mm AS (SELECT id, title, text, regexp_extract_all(text, '{MENTION_PATTERN}') AS m, regexp_split_to_array(text, '{MENTION_PATTERN}') AS p FROM postings),
mx AS (SELECT id, title, text, generate_subscripts(m, 1) AS k, unnest(m) AS surface, unnest(p[1:len(m)]) AS gap FROM mm),
mn AS (SELECT id, title, text, surface, CAST(sum(length(gap)) OVER (PARTITION BY id ORDER BY k) + sum(length(surface)) OVER (PARTITION BY id ORDER BY k) - length(surface) AS BIGINT) AS place FROM mx),
men AS (SELECT mn.*, {CANON_SQL} AS canonical, sec.label AS section FROM mn JOIN sec ON sec.id = mn.id AND place >= start AND place < "end")"""


@query("er_mentions", f"WITH {MENTIONS_SQL} SELECT id, surface, place, canonical, section FROM men")
def mentions_query(spark: SparkSession, sf: str) -> DataFrame:
    """Names in postings, by alias under one name, with the section that they stand in."""
    return mentions(postings(spark, sf)).select("id", "surface", F.col("offset").alias("place"), "canonical", "section")


_TIER_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(s, '{p}')" for p in ps) + f" THEN {k}" for k, ps in enumerate(TIERS.values(), 1)) + " ELSE 3 END"
WEIGHT_SQL = f"""{MENTIONS_SQL}, q AS (SELECT *, lower(regexp_replace(substr(text, greatest(place - {LOOKBACK}, 0) + 1, least(place, {LOOKBACK})), '(?s)^.*[.!?\\n•;]', '')) AS s FROM men),
gw AS (SELECT id, canonical, max(CASE section {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SECTION_BASE.items())} END) AS section_base, count(DISTINCT (place, surface)) AS n, min(place) AS first, any_value(title) AS title, max(length(text)) AS size, min({_TIER_SQL}) AS rank FROM q GROUP BY 1, 2),
w AS (SELECT id, canonical, n, section_base + CASE WHEN contains(' ' || lower(title) || ' ', ' ' || lower(canonical) || ' ') THEN .25 ELSE 0 END + least(.18, .09 * log2(n)) + .10 * (1 - first / size) + CASE rank WHEN 1 THEN .15 WHEN 2 THEN .08 WHEN 3 THEN 0 ELSE -.12 END AS raw FROM gw)"""


@query("er_weights", f"WITH {WEIGHT_SQL} SELECT id, canonical, n AS mentions, round(greatest(.05, least(1, raw)), 6) AS weight FROM w")
def weights_query(spark: SparkSession, sf: str) -> DataFrame:
    """What each skill of a posting weighs."""
    return weights(postings(spark, sf)).select("id", "canonical", F.col("n").alias("mentions"), F.round("weight", 6).alias("weight"))


@query("er_qualifier", f"WITH {WEIGHT_SQL}, t AS (SELECT id, surface, place, {_TIER_SQL} AS k FROM q) SELECT id, surface, place, ['expert', 'proficient', 'working', 'awareness'][k] AS tier FROM t")
def qualifier_query(spark: SparkSession, sf: str) -> DataFrame:
    p = postings(spark, sf)
    return mentions(p).join(p, "id").select("id", "surface", F.col("offset").alias("place"), qualifier(F.col("text"), F.col("offset")).alias("tier"))


@query("er_readiness", f"WITH {WEIGHT_SQL}, c AS (SELECT id, count(*) AS nodes, count(*) FILTER (greatest(.05, least(1, raw)) >= .5) AS strong FROM w GROUP BY 1) SELECT id, nodes, strong, CASE WHEN nodes = 0 THEN 'empty' WHEN strong = 0 THEN 'unweighted' WHEN nodes < 5 THEN 'thin' ELSE 'ready' END AS state FROM c")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a posting's graph is fit for use, by counts of its nodes and of its strong ones."""
    c = weights(postings(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("weight") >= 0.5).alias("strong"))
    return c.withColumn("state", F.when(F.col("nodes") == 0, "empty").when(F.col("strong") == 0, "unweighted").when(F.col("nodes") < 5, "thin").otherwise("ready"))


@query("er_serialised", f"WITH {WEIGHT_SQL} SELECT id, round(max(greatest(.05, least(1, raw))), 6) AS parent_weight, list(canonical ORDER BY round(greatest(.05, least(1, raw)), 9) DESC, canonical) AS children FROM w GROUP BY 1 HAVING count(*) > 1")
def serialised(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels: a parent weighs as its heaviest child, and one with a single child isn't kept."""
    w = weights(postings(spark, sf))
    g = w.groupBy("id").agg(F.round(F.max("weight"), 6).alias("parent_weight"), F.array_sort(F.collect_list(F.struct((-F.round("weight", 9)).alias("w"), "canonical"))).alias("c"))
    return g.filter(F.size("c") > 1).select("id", "parent_weight", F.transform("c", lambda x: x["canonical"]).alias("children"))


@query("txt_fragments", f"WITH {MENTIONS_SQL} SELECT DISTINCT canonical, canonical IN ('pipelines', 'data pipelines') OR length(canonical) < 3 AS fragment FROM men")
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Names that say nothing on their own: all of their words are general ones, or they are too short.

    Every text has a section everywhere, so which names are mentioned hangs on the texts alone, not on places.
    """
    general = F.array(F.lit("data"), F.lit("pipelines"))
    found = postings(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(name_pattern()), F.lit(0))).alias("surface")).distinct()
    m = found.select(canonical(F.col("surface")).alias("canonical")).distinct()
    return m.select("canonical", (F.forall(F.split("canonical", " "), lambda t: F.array_contains(general, t)) | (F.length("canonical") < 3)).alias("fragment"))


@query("txt_span_check", "WITH s AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN substr(text, 3, 40) WHEN 1 THEN replace(substr(text, 3, 40), ' ', '  ') WHEN 2 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) ELSE 'nothing of the kind' END AS span FROM benchmark) SELECT item_id, CASE WHEN contains(text, span) THEN 'exact' WHEN contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(span, '\\s+', ' ', 'g')))) THEN 'spaced' WHEN item_id % 4 = 2 THEN 'paraphrase' ELSE 'unverified' END AS verdict FROM s")
def span_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what is quoted stands in a text: as it is, once cased and spaced alike, its words in their order, or not at all."""
    from graphloom.functions.text import contains_in_order, graded_form

    words, k = F.split("text", " "), F.col("item_id") % 4
    quoted = F.when(k == 0, F.substring("text", 3, 40)).when(k == 1, F.replace(F.substring("text", 3, 40), F.lit(" "), F.lit("  "))).when(k == 2, F.concat_ws(" ", F.get(words, 0), F.get(words, 2), F.get(words, 3))).otherwise("nothing of the kind")
    b = table(spark, sf, "benchmark").select("item_id", "text", quoted.alias("span"))
    in_order = contains_in_order(F.split(graded_form(F.col("text")), " "), F.split(graded_form(F.col("span")), " "))
    v = F.when(F.contains("text", F.col("span")), "exact").when(F.contains(graded_form(F.col("text")), graded_form(F.col("span"))), "spaced").when(in_order, "paraphrase").otherwise("unverified")
    return b.select("item_id", v.alias("verdict"))


@query("er_containment", "WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT split_part(lower(p_name), ' ', 2) FROM part), p AS (SELECT s.name, l.name AS keeper, row_number() OVER (PARTITION BY s.name ORDER BY length(l.name) DESC, l.name) AS k FROM n s JOIN n l ON NOT contains(s.name, ' ') AND length(s.name) >= 5 AND split_part(l.name, ' ', 2) = s.name) SELECT name, keeper FROM p WHERE k = 1")
def containment(spark: SparkSession, sf: str) -> DataFrame:
    """Names that a longer one holds as whole words in their order, five characters at least: the longest such keeps them.

    A shorter name meets longer ones by its first word.
    """
    from graphloom.functions.text import contains_in_order

    p = table(spark, sf, "part").select(F.lower("p_name").alias("name"))
    n = p.union(p.select(F.get(F.split("name", " "), 1))).distinct().withColumn("words", F.split("name", " "))
    short = n.filter(F.length("name") >= 5).select("name", "words", F.get("words", 0).alias("word"))
    long = n.select(F.col("name").alias("keeper"), F.col("words").alias("all"), F.explode(F.array_distinct("words")).alias("word"))
    j = short.join(long, "word").filter(contains_in_order(F.col("all"), F.col("words")))
    return j.groupBy("name").agg(F.min_by("keeper", F.struct((-F.length("keeper")).alias("n"), "keeper")).alias("keeper"))


@query("txt_shared_stem", "WITH w AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: left(x, 5)) AS a, left(lower(p_type), 5) AS b FROM part) SELECT p_partkey, list_contains(a, b) AS shared FROM w")
def shared_stem(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two names share the first five letters of a word's stem; names of these tables have no suffixes to cut."""
    heads = F.transform(F.split("p_name", " "), lambda x: F.left(x, F.lit(5)))
    return table(spark, sf, "part").select("p_partkey", F.arrays_overlap(heads, F.array(F.left(F.lower("p_type"), F.lit(5)))).alias("shared"))
