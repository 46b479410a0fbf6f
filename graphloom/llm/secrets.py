"""Secret scans with corpus-wide ownership frequency.

Candidates of three kinds are found in every whole text; their hashes are counted by distinct repositories (documents)
and owners (sources). A value that many owners hold is a copied example; one that stays with one owner and looks
random is live-looking, and the scan adds a span of kind ``live`` for it.

A text with very many matches costs time in proportion: places are summed up in blocks, and only (row, position, hash)
is exploded to meet the verdicts. A null text has no candidates. A null source is an owner of its own, a null doc_id a repository of its own. Repeated
rows count once as repository and get the same result each. Other columns are ignored; an empty table gives an empty
table. Nothing is kept of a value in the counts but its SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import let, materialize, whole_text

# The contract's patterns and least lengths, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of 18 or more: a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12


@dataclass(frozen=True)
class Ownership:
    """When a candidate's value counts as a copied example, and when as live-looking."""

    example_owners: int = 3  # held by so many owners: a copied example
    example_repositories: int = 25  # or in so many repositories
    least_distinct: int = 8  # a live-looking value has so many different characters ...
    least_digits: int = 2  # ... so many digits ...
    least_letters: int = 2  # ... and so many letters: a number alone is no credential
    placeholders: str = r"(?i)(example|sample|dummy|placeholder|changeme|test|xxxx|your[_-]?|1234567|abcdef)"


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
BLOCK = 128  # matches whose places are summed up at a time


def found(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points; the pieces between give the places.

    Places are running sums, within blocks of matches first and then over blocks, so that a text with very many
    matches never copies all that it has found for each further one.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def inside(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + F.length(x["piece"])
            e = s + F.length(x["match"])
            one = F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["match"].alias("value"))
            return F.struct(e.alias("at"), F.concat(a["spans"], F.array(one)).alias("spans"))

        return F.aggregate(block, start, step)

    def across(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("all"))

        def step(a: Column, block: Column) -> Column:
            moved = F.transform(block["spans"], lambda x: F.struct((x["start"] + a["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + a["at"]).alias("end"), x["value"].alias("value")))
            return F.struct((a["at"] + block["at"]).alias("at"), F.concat(a["all"], F.array(moved)).alias("all"))

        return F.aggregate(blocks, start, step, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["all"]).alias("spans")))

    def in_blocks(rows: Column, one: Callable[[Column], Column]) -> Column:
        return let(rows, lambda r: F.transform(F.sequence(F.lit(1), F.size(r), F.lit(BLOCK)), lambda k: one(F.slice(r, k, F.lit(BLOCK)))))

    def placed(m: Column, p: Column) -> Column:
        rows = F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda a, b: F.struct(b.alias("piece"), a.alias("match")))
        return across(in_blocks(in_blocks(rows, inside), across))["spans"]

    return F.when(text.rlike(pattern), let(matches, lambda m: let(pieces, lambda p: placed(m, p)))).otherwise(F.array().cast(SPANS))


def candidates(text: Column) -> Column:
    """All base spans of a text by start, then kind; of assignments, value is what is assigned."""
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 2)
    assigned = F.transform(found(text, ASSIGN, 0), lambda x: x.withField("value", value(x)))
    assigned = F.filter(assigned, lambda x: F.length(x["value"]) >= LEAST_ASSIGNED)
    return F.array_sort(F.concat(assigned, found(text, ACCESS, 1), found(text, HEX, 2)))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def looks_live(value: Column, rules: Ownership) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    digits = F.length(value) - F.length(F.translate(value, "0123456789", ""))
    letters = F.regexp_count(value, F.lit("[A-Za-z]"))
    return (distinct >= rules.least_distinct) & (digits >= rules.least_digits) & (letters >= rules.least_letters) & ~value.rlike(rules.placeholders)


def scan(docs: DataFrame, rules: Ownership = Ownership()) -> DataFrame:
    """row (a number), doc_id, source, found: every row with its base spans and the hash of each one's value; texts stay behind."""
    mark = lambda x: x.withField("hash", F.sha2(x["value"], 256)).withField("random", looks_live(x["value"], rules)).dropFields("value")
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.transform(candidates(whole_text()), mark).alias("found"))


def ownership(scanned: DataFrame, rules: Ownership = Ownership()) -> DataFrame:
    """A row for each candidate hash: its distinct repositories and owners, and the verdict.

    Occurrences are made distinct by (hash, owner, repository) and then counted by (hash, owner), each with map-side
    aggregation, so a value with a third of all rows reaches the last step as one row for each owner and task.
    """
    each = scanned.select("doc_id", "source", F.explode("found").alias("f")).select("doc_id", "source", "f.hash", "f.random").distinct()
    owners = each.groupBy("hash", "source", "random").agg(F.count(F.lit(1)).alias("n"))
    counts = owners.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.max("random").alias("random"))
    copied = (F.col("n_owners") >= rules.example_owners) | (F.col("n_repositories") >= rules.example_repositories)
    verdict = F.when(copied, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return counts.select("hash", "n_repositories", "n_owners", verdict.alias("verdict"))


def secrets(docs: DataFrame, rules: Ownership = Ownership()) -> DataFrame:
    """One row per document: doc_id, base and added spans, and its candidates by verdict."""
    scanned = materialize(scan(docs, rules), "secrets")
    hit = scanned.filter(F.size("found") > 0)
    verdicts = ownership(hit, rules).filter("verdict <> 'unclear'")
    places = hit.select("row", F.posexplode("found").alias("at", "x")).select("row", "at", F.col("x.hash").alias("hash"))
    told = places.join(verdicts, "hash").select("row", F.when(F.col("verdict") == "live", F.col("at")).alias("live"), "verdict", "n_owners")
    own = told.groupBy("row").agg(F.collect_list("live").alias("live"), F.count_if(F.col("verdict") == "example").alias("n_example"), F.max("n_owners").alias("most_owners"))
    j = hit.join(own, "row", "left").select("doc_id", "found", "live", "n_example", "most_owners")
    j = j.unionByName(scanned.filter(F.size("found") == 0).select("doc_id", "found"), allowMissingColumns=True)
    live = F.transform(F.coalesce("live", F.array().cast("array<int>")), lambda k: F.get("found", k).withField("kind", F.lit(3)))
    j = j.withColumn("live", live)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return j.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("found")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("found", "live"))).alias("spans"), F.size("live").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("int").alias("n_example"), F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
