"""Names, paths, identifiers and digests as expressions over columns; null in, null out, unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a file, and the most characters of a slug and of a description.
STOPWORDS = ("src", "lib", "app", "index", "main", "js", "ts", "tsx", "jsx", "py", "test", "tests", "spec", "core", "utils", "util", "common", "shared", "helpers", "helper", "base", "the", "a", "of", "mjs", "cjs")
LONG_SLUG, DESCRIPTION = 120, 400
NIL_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def long_slug(text: Column, most: int = LONG_SLUG) -> Column:
    """Lower case, runs of other characters as one hyphen; a long one is cut at a hyphen; 'unnamed' where nothing is left."""
    whole = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.left(whole, F.lit(most))
    at_word = F.when(F.contains(cut, F.lit("-")), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)
    s = F.when(F.length(whole) > most, at_word).otherwise(whole)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unnamed")).otherwise(s)


def one_spaced(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def graded_form(text: Column) -> Column:
    """What answers are compared by; null is empty. Lower case stands for case folding."""
    return F.lower(one_spaced(F.coalesce(text, F.lit(""))))


def name_tokens(text: Column) -> Column:
    """Distinct parts of a name, cut at other characters and before capitals, without stop words and single letters."""
    parts = F.split(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " "), "[^A-Za-z0-9]+")
    kept = F.filter(F.transform(parts, F.lower), lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS))
    return F.array_distinct(kept)


def similarity(a: Column, b: Column) -> Column:
    """Shared tokens by all tokens; 0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_in_order(longer: Column, shorter: Column) -> Column:
    """Whether the shorter array's items all come in the longer one in their order; equal lengths and none don't count."""
    found = F.aggregate(longer, F.lit(0), lambda i, t: F.when(t == F.get(shorter, i), i + 1).otherwise(i))
    return (F.size(shorter) > 0) & (F.size(shorter) < F.size(longer)) & (found == F.size(shorter))


def tail(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def shortest_distinct(paths: Column) -> Column:
    """The last two parts of each path, where these tell all paths apart; else the paths."""
    tails = F.transform(paths, tail)
    return F.when(F.size(F.array_distinct(tails)) == F.size(tails), tails).otherwise(paths)


def git_origin(url: Column) -> Column:
    """host, owner, name of an https or ssh remote in lower case of its host; nulls where it is neither."""
    pattern = r"^(?:https?://(?:[^@/]+@)?|ssh://(?:[^@/]+@)?|[^@/:]+@)([^/:]+)(?::\d+(?=/))?[/:](.+?)/([^/]+?)(?:\.git)?/?$"
    part = lambda k: F.when(url.rlike(pattern), F.regexp_extract(url, pattern, k))
    return F.struct(F.lower(part(1)).alias("host"), part(2).alias("owner"), part(3).alias("name"))


def plain_text(markdown: Column) -> Column:
    """Links and images as their words, emphasis and code marks gone, entities as characters, spaces single."""
    steps = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"[*_`]+", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return one_spaced(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, markdown))


def cut_at_word(text: Column, most: int = DESCRIPTION) -> Column:
    """At most so many characters, whole words and an ellipsis where some are left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.regexp_replace(F.left(text, F.lit(most)), r"\s+\S*$", "")), F.lit("…")))


def clean_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\w']", "")


def glob_pattern(glob: str) -> str:
    """A glob (*, ?, [..]) as a regular expression over a whole name."""
    out = []
    for part in re.split(r"(\*|\?|\[!?[^\]]+\])", glob):
        out.append(".*" if part == "*" else "." if part == "?" else "[^" + part[2:] if part.startswith("[!") else part if part.startswith("[") else re.escape(part))
    return "^(?:" + "".join(out) + ")$"


def uuid5(name: Column, namespace: str = NIL_DNS) -> Column:
    """The version 5 identifier of a name: SHA-1 of namespace and name, with the version's and variant's bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fenced_json(text: Column) -> Column:
    """The content of a code fence around an answer, or the answer."""
    return F.btrim(F.regexp_replace(F.btrim(text, F.lit(" \n\t\r")), r"^```[A-Za-z]*\s*|\s*```$", ""), F.lit(" \n\t\r"))


# The 32-bit FNV-1a hash.
FNV_START, FNV_PRIME = 2166136261, 16777619


def fingerprint(text: Column) -> Column:
    """The last six base-36 digits of the FNV-1a hash of a text's UTF-16 units."""
    wide = F.encode(text, "UTF-16BE")
    unit = lambda k: F.conv(F.hex(F.substring(wide, 2 * k + 1, F.lit(2))), 16, 10).cast("long")
    places = F.when(text == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.octet_length(wide) / 2).cast("int") - 1))
    step = lambda h, k: (h.bitwiseXOR(unit(k)) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    return F.right(F.concat(F.lit("00000"), F.lower(F.conv(F.aggregate(places, F.lit(FNV_START), step).cast("string"), 10, 36))), F.lit(6))


_FNV = f"list_reduce(list_prepend({FNV_START}::BIGINT, list_transform(string_split({{x}}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * {FNV_PRIME}) & 4294967295)"
FINGERPRINT_SQL = "array_to_string(list_transform([5, 4, 3, 2, 1, 0], lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((" + _FNV + " // CAST(36 ** k AS BIGINT)) % 36 AS INTEGER) + 1, 1)), '')"
