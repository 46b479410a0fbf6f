"""Text operators as JVM-side expressions: readability, slugs, normalised names, token similarity, digests."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.rounds import dealt
from graphloom.registry import query
from graphloom.session import table

# Phrases that hedge, words that intensify weakly, words that fill, and the shape of a passive.
HEDGES = ("maybe", "perhaps", "possibly", "sort", "kind", "somewhat", "probably", "i think", "i guess", "i feel", "just", "actually", "basically")
WEAK = ("very", "really", "quite", "rather", "extremely", "totally", "literally", "definitely")
FILLERS = ("thing", "things", "stuff", "etc")
#: The passive's shape where words end at ASCII letters: every other character is doubled, and each match takes one on either side.
PASSIVE_SQL = r"(^|[^\p{L}\p{N}_])(is|are|was|were|be|been|being)[ \t\n\x0b\f\r\x{85}\x{a0}]+[\p{L}\p{N}_]*[\p{L}\p{N}_](ed|en)([^\p{L}\p{N}_]|$)"


_WORD, _VOWELS, _STOP, _BLANK = re.compile("[a-z']+"), re.compile("[aeiouy]+"), re.compile("[.!?]+"), " \t\n\x0b\f\r"
_PASSIVE = re.compile(r"\b(?:is|are|was|were|be|been|being)\b[ \t\n\x0b\f\r\x85\xa0]+\w+(?:ed|en)\b")
COUNTS = ("n_words", "n_distinct", "letters", "n_syllables", "n_weak", "n_fillers", "n_sentences", "n_hedges", "n_passive")


@lru_cache(1 << 16)
def syllables(word: str) -> int:
    """Vowel groups, less one for a final e that isn't the only one; 1 at least."""
    n = len(_VOWELS.findall(word))
    return max(n - (word.endswith("e") and n > 1), 1)


def text_counts(text: str) -> tuple[int, ...]:
    """What COUNTS names, of one text. Hedges count between single spaces, without overlap."""
    low = text.lower()
    padded, words = f" {low.strip(' \t\n\r')} ", Counter(_WORD.findall(low))
    return (
        words.total(), len(words), sum(len(w) * n for w, n in words.items()), sum(syllables(w) * n for w, n in words.items()), sum(words[w] for w in WEAK), sum(words[w] for w in FILLERS),
        max(1, sum(1 for x in _STOP.split(text) if x.strip(_BLANK))), sum(padded.count(f" {h} ") for h in HEDGES), len(_PASSIVE.findall(padded)),
    )


def counted(texts: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every text, null as empty: each batch of texts is read once, and only counts come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t or "") for t in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])

    return dealt(texts.select("doc_id", "text")).mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def fixed(x: Column, digits: int) -> Column:
    """Rounded to digits by way of nine, in decimals: a tie is one whatever a double's last bits are."""
    return F.round(x.cast("decimal(18,9)"), digits).cast("double")


FIXED_SQL = "CAST(round(CAST({x} AS DECIMAL(18,9)), {n}) AS DOUBLE)"
HEDGE_SQL = " + ".join(f"len(regexp_extract_all(p, ' {h} '))" for h in HEDGES)
CLAMP = "greatest(0e0, least(100e0, {x}))"


@query("txt_writing_metrics", f"""WITH t AS (SELECT doc_id, ' ' || lower(trim(coalesce(text, ''), E' \\t\\n\\r')) || ' ' AS p, regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+') AS w, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '\\S'))) AS s FROM documents),
m AS (SELECT doc_id, len(w) AS n_words, greatest(s, 1) AS n_sentences, len(list_distinct(w)) AS n_distinct, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters, coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1))), 0) AS syl,
{HEDGE_SQL} AS n_hedges, len(list_filter(w, lambda x: x IN {WEAK})) AS n_weak, len(list_filter(w, lambda x: x IN {FILLERS})) AS n_fillers, len(regexp_extract_all(regexp_replace(p, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '{PASSIVE_SQL}')) AS n_passive FROM t),
d AS (SELECT *, n_distinct / sqrt(n_words) AS ttr, letters / n_words AS word, n_words / n_sentences AS sentence, 206.835e0 - 1.015e0 * n_words / n_sentences - 84.6e0 * syl / n_words AS flesch, (n_hedges + n_weak + n_fillers + n_passive) / n_words * 100e0 AS density FROM m WHERE n_words > 0)
SELECT doc_id, n_words, n_sentences, CAST(syl AS BIGINT) AS n_syllables, n_hedges, n_weak, n_fillers, n_passive, {FIXED_SQL.format(x='ttr', n=6)} AS root_ttr, {FIXED_SQL.format(x='flesch', n=6)} AS flesch, {FIXED_SQL.format(x=CLAMP.format(x='45e0 + (ttr - 4.5e0) * 16e0 + (word - 4.2e0) * 9e0'), n=4)} AS vocabulary,
{FIXED_SQL.format(x=CLAMP.format(x='CASE WHEN flesch >= 75 THEN 100e0 - (flesch - 75e0) * .8e0 WHEN flesch >= 50 THEN 100e0 ELSE greatest(0e0, 100e0 - (50e0 - flesch) * 1.3e0) END'), n=4)} AS clarity, {FIXED_SQL.format(x=CLAMP.format(x='100e0 - 6e0 * density - 2e0 * greatest(0e0, sentence - 24e0)'), n=4)} AS precision FROM d""")
def writing_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, root type-token ratio, Flesch reading ease, and the three scores made of them, of every text with a word."""
    n = F.col("n_words")
    m = counted(table(spark, sf, "documents")).filter("n_words > 0").withColumn("ttr", F.col("n_distinct") / F.sqrt(n)).withColumn("flesch", 206.835 - 1.015 * n / F.col("n_sentences") - 84.6 * F.col("n_syllables") / n)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    f, density = F.col("flesch"), (F.col("n_hedges") + F.col("n_weak") + F.col("n_fillers") + F.col("n_passive")) / n * 100
    clarity = F.when(f >= 75, 100 - (f - 75) * 0.8).when(f >= 50, 100.0).otherwise(100 - (50 - f) * 1.3)
    scores = {"vocabulary": 45 + (F.col("ttr") - 4.5) * 16 + (F.col("letters") / n - 4.2) * 9, "clarity": clarity, "precision": 100 - 6 * density - 2 * F.greatest(F.lit(0.0), n / F.col("n_sentences") - 24)}
    return m.select("doc_id", "n_words", "n_sentences", "n_syllables", "n_hedges", "n_weak", "n_fillers", "n_passive", fixed(F.col("ttr"), 6).alias("root_ttr"), fixed(f, 6).alias("flesch"), *(fixed(clamp(v), 4).alias(k) for k, v in scores.items()))


def slug(s: Column, most: int = 100) -> Column:
    return F.left(F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(most))


@query("str_slugify", "SELECT p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 100) AS slug FROM part")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


@query("str_normalize", "SELECT c_custkey, lower(trim(c_name)) AS name FROM customer")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.lower(F.trim("c_name")).alias("name"))


@query("hash_content", "SELECT item_id, sha256(text) AS sha FROM benchmark")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("sha"))


@query("set_jaccard", """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), p AS (SELECT a.item_id, b.item_id AS other, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM t a JOIN t b ON b.item_id = a.item_id + 1)
SELECT item_id, other, round(CASE WHEN n - i = 0 THEN 0 ELSE i / (n - i) END, 9) AS similarity FROM p""")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Token-set similarity of each item and the next."""
    t = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("w").alias("v"))
    union = F.size(F.array_union("w", "v"))
    return t.join(b, "item_id").select("item_id", "other", F.round(F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("w", "v")) / union), 9).alias("similarity"))


@query("src_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@query("flt_intent", "SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'security' WHEN contains(lower(text), 'rights') THEN 'legal' WHEN contains(lower(text), 'http') THEN 'web' ELSE 'general' END AS intent FROM documents")
def intent(spark: SparkSession, sf: str) -> DataFrame:
    """The first keyword that matches decides."""
    has = lambda k: F.contains(F.lower("text"), F.lit(k))
    return table(spark, sf, "documents").select("doc_id", F.when(has("password"), "security").when(has("rights"), "legal").when(has("http"), "web").otherwise("general").alias("intent"))


@query("json_lookup", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("math_repetition_bonus", "SELECT p_partkey, round(least(.2, .05 * log2(greatest(1, p_size))), 9) AS bonus FROM part")
def repetition_bonus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(F.least(F.lit(0.2), 0.05 * F.log2(F.greatest(F.lit(1), F.col("p_size")).cast("double"))), 9).alias("bonus"))
