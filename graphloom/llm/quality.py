"""Quality rules: line-first cleaning, and the repetition and length statistics of whole texts.

A null text has no words and no lines. Empty lines are neither judged nor counted. Each row is judged on its own, so
ties, repeated rows and other columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import BLANKS, let, rows_of, whole_text, words_of

# The contract's symbols, its window, and its limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30


@dataclass(frozen=True)
class LineRules:
    """When a line fails, and how much of a document's text may go with failing lines."""

    ends: str = r"[.!?…。！？:;\"'”’»)\]]\s*$"  # what a line of prose ends with
    bare_words: int = 12  # a line that doesn't end so fails if it has fewer words
    separators: str = r"\s[|»›>•·/]\s"  # between the entries of a navigation bar
    navigation: int = 2  # a line with so many separators, and no more than ...
    entry_words: float = 4.0  # ... so many words an entry, is navigation
    boilerplate: str = r"(?i)\b(all rights reserved|privacy policy|terms of (use|service)|cookie policy|use cookies|accept cookies|enable javascript|lorem ipsum|click here|sign (in|up)|log ?in|subscribe (now|to our)|powered by|copyright ©|©\s*\d{4}|back to top|skip to (main )?content)\b"
    boilerplate_words: int = 30  # longer lines only mention such a phrase
    symbol_percent: int = 10  # symbols, as a share of the line's characters, that make it junk
    most_lost_percent: int = 50  # a document goes if failing lines hold more of its text


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more, each window's first place included.

    Windows are hashed once; where all differ the answer is 0, and only else are (hash, place) pairs sorted and the
    covered words counted in order of place. Cost is n log n at worst.
    """

    def covered(pairs: Column) -> Column:
        same_as = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(pairs, lambda x, k: same_as(k - 1, x) | same_as(k + 1, x))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def over(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(F.slice(w, i + 1, window)))
        pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs(h), covered)))

    return let(words, lambda w: F.when(F.size(w) < window, F.lit(0)).otherwise(over(w)))


def line_fails(line: Column, rules: LineRules) -> Column:
    """True if a line with a word fails a rule; evaluated cheapest rule first."""
    n = F.size(words_of(line))
    separators = F.regexp_count(line, F.lit(rules.separators))
    navigation = line.rlike(rules.separators) & (separators >= rules.navigation) & (n <= rules.entry_words * (separators + 1) + separators)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    return (~line.rlike(rules.ends) & (n < rules.bare_words)) | (symbols * 100 > F.length(line) * rules.symbol_percent) | navigation | (line.rlike(rules.boilerplate) & (n < rules.boilerplate_words))


def quality_stats(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The input's columns, with struct column __q: the statistics, base_failed, cleaned text and verdict."""
    text = whole_text()
    count = lambda a: F.size(a).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    parts = F.struct(words_of(text).alias("words"), F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x, rules).alias("bad"))).alias("lines"))

    def facts(p: Column) -> Column:
        size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x["line"]))
        own = F.transform(p["lines"], lambda x: x["line"])
        good = F.filter(p["lines"], lambda x: ~x["bad"])
        return F.struct(
            count(p["words"]).alias("n_words"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
            repeated_words(p["words"]).cast("long").alias("n_repeat_words"),
            F.size(own).alias("n_lines"), F.size(good).alias("n_kept_lines"), size(p["lines"]).alias("line_chars"), size(good).alias("kept_chars"),
            F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("cleaned"),
        )

    q = let(parts, facts)
    failed = lambda f: (f["n_words"] < LEAST_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MOST_REPEATED_PERCENT)
    lost = lambda f: (f["line_chars"] - f["kept_chars"]) * 100 > f["line_chars"] * rules.most_lost_percent
    return docs.withColumn("__q", let(q, lambda f: f.withField("base_failed", failed(f)).withField("kept", ~failed(f) & ~lost(f))))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, all columns; their text without the lines that fail."""
    # A filter over the struct would be moved below it and compute it again; a generator's output isn't.
    q = quality_stats(rows_of(docs, text="text"), rules).select("row", F.explode_outer(F.filter(F.array("__q"), lambda x: x["kept"])).alias("q"))
    q = q.filter("q is not null")
    new = {"text": F.col("q.cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("q.cleaned").cast(docs.schema["n_chars"].dataType)
    return q.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_stats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return q.select("doc_id", *(f"__q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_kept_lines", "line_chars", "kept_chars")))
