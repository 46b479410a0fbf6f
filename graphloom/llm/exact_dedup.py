"""Exact dedup by progressive refinement: length, then a prefix's hash, then the full hash.

Nulls and ties: a null text counts as the empty text, so null and empty texts are copies of each other. A null
doc_id is smaller than any other; a group whose ids are all null keeps one row with keep_id null. Rows that agree in
text and doc_id are ties of which one is kept. Very long texts are hashed as one value. Other columns, whatever their
names, pass through keep_exact and are ignored by exact_dedup; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, rows_of, same, whole_text

PREFIX_CHARS = 256


def refined(rows: DataFrame) -> DataFrame:
    """The rows, with ``hit``: true where others share length and prefix hash, else null.

    rows: len, pre and any others. Copies are aggregated by (len, pre) before they are shuffled, and the first
    refinement, by length, sees one row for each such pair; a group with a third of all rows costs one row a task.
    """
    pairs = rows.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n"))
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("n")).filter("n > 1").select("len")
    alike = pairs.join(lengths, "len", "left_semi").filter("n > 1").select("len", "pre", F.lit(True).alias("hit"))
    return rows.join(alike, ["len", "pre"], "left")


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for documents that no refinement found alike, unless ``digest`` asks for a digest of each: then
    every text is hashed where it is read, and 32 bytes of it travel; else survivors' texts do.
    """
    length, prefix = F.length(whole_text()), F.xxhash64(F.substring(whole_text(), 1, prefix_chars))
    value = F.sha2(whole_text(), 256) if digest else whole_text()
    r = refined(docs.select("doc_id", length.alias("len"), prefix.alias("pre"), value.alias("value")))
    hashed = F.col("value") if digest else F.sha2("value", 256)
    own = F.when(F.col("hit"), hashed)
    n = materialize(r.select("doc_id", own.alias("h"), (F.col("value") if digest else own).alias("text_sha256")), "exact")
    groups = n.filter("h is not null").groupBy("h").agg(F.max("doc_id").alias("g_keep"), F.count(F.lit(1)).alias("g_size")).filter("g_size > 1")
    # Rows that no refinement found alike have no full hash; joined as nulls they would all meet in one task.
    j = n.filter("h is not null").join(groups, "h", "left").unionByName(n.filter("h is null"), allowMissingColumns=True)
    out = j.select("doc_id", F.when(F.col("g_size").isNull(), F.col("doc_id")).otherwise(F.col("g_keep")).alias("keep_id"), F.coalesce("g_size", F.lit(1)).alias("group_size"), "h", "text_sha256")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Only rows at the top of a real group can tie, so the window runs over those alone.
    tied = out.filter(top & (F.col("group_size") > 1)).withColumn("rn", F.row_number().over(W.partitionBy("h", "doc_id").orderBy(F.lit(1)))).withColumn("kept", F.col("rn") == 1).drop("rn")
    rest = out.filter(~(top & (F.col("group_size") > 1))).withColumn("kept", top)
    return rest.unionByName(tied).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_exact(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents, all columns, of which exact_dedup keeps the row.

    Rows move once, to meet the verdict on their length and prefix. Survivors of both refinements are hashed once, and
    compared by id and hash, so that no large group makes a hot task; all other rows go on unhashed.
    """
    length, prefix = F.length(whole_text()), F.xxhash64(F.substring(whole_text(), 1, prefix_chars))
    r = refined(rows_of(docs, doc_id="doc_id", len=length, pre=prefix))
    d = materialize(r.select("row", "doc_id", F.when(F.col("hit"), F.sha2(whole_text("row.text"), 256)).alias("hash")), "refined")
    alike = d.filter("hash is not null")
    ids = alike.select("doc_id", "hash")
    keep = materialize(ids.groupBy("hash").agg(F.max("doc_id").alias("doc_id")), "keep")
    if not ids.groupBy("doc_id", "hash").count().filter("count > 1").isEmpty():  # rows that agree in id and text: one of them goes on
        alike = alike.dropDuplicates(["doc_id", "hash"])
    kept = alike.alias("a").join(keep.alias("b"), same("a", "b", ["doc_id", "hash"]), "left_semi")
    return d.filter("hash is null").unionByName(kept).select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
