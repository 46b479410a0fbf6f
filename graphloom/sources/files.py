"""File sources and sinks: listings, answer keys, type sniffing, partition overwrite, upsert, snapshots, artifacts, deletion and eviction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.rounds import placed

# Folders that a listing leaves out, and the first bytes of file types.
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "gif": b"GIF8", "zip": b"PK\x03\x04"}


def list_files(spark: SparkSession, root: str, pattern: str = "*", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path below root, length, modified; the bytes are not read. Spark's reader leaves empty files out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_replace(F.col("path"), r"^.*?/" + "".join("\\" + c if not c.isalnum() else c for c in tail) + "/", "")
    listed = f.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"))
    return listed.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """value: the entries of a list in text form, without bullets, back-ticks, comments and empty lines."""
    v = F.btrim(F.regexp_replace(F.regexp_replace("value", r"^\s*([-*+]|\d+\.)\s+", ""), "`", ""))
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*#")).select(v.alias("value")).filter("value <> ''")


def sniffed_type(content: Column) -> Column:
    """Type by the first bytes; text where no byte is zero and they are UTF-8, else binary; null of null."""
    out = F.when(F.is_valid_utf8(content) & (F.instr(content.cast("string"), "\0") == 0), "text").otherwise("binary")
    for name, head in MAGIC.items():
        out = F.when(F.substring(content, 1, len(head)) == F.lit(bytearray(head)), name).otherwise(out)
    return F.when(content.isNotNull(), out)


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep_unseen: bool = True) -> DataFrame:
    """Rows of ``changes`` replace those of equal keys; the rest of ``current`` stays, or goes if not keep_unseen."""
    if not keep_unseen:
        return changes.select(*current.columns)
    return current.join(changes.select(*keys), keys, "left_anti").select(*current.columns).unionByName(changes.select(*current.columns))


def write_snapshot(df: DataFrame, root: str) -> str:
    """Appends a snapshot in a folder of its own; Spark's _SUCCESS marks it as whole. Returns the folder."""
    path = f"{root.rstrip('/')}/snapshot={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def write_artifact(graph: DataFrame, path: str, keep: DataFrame | None = None) -> None:
    """The records as lines of compact JSON, nulls left out; with ``keep`` (id) those alone. Many tasks write many files."""
    g = graph.join(keep, "id", "left_semi") if keep is not None else graph
    g.select(F.to_json(F.struct(*g.columns)).alias("value")).write.mode("overwrite").text(path)


def cascade_delete(tables: dict[str, DataFrame], key: str, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table without the rows of some ids, in the order given, and how many rows each loses."""
    gone = ids.select(key).distinct()
    left = {name: t.join(gone, key, "left_anti") for name, t in tables.items()}
    audit = None
    for name, t in tables.items():
        n = t.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        audit = n if audit is None else audit.unionByName(n)
    return left, audit


def evicted(items: DataFrame, cap: int) -> DataFrame:
    """The items (id, size, used, added) that go, least lately used first, until what stays is within the cap.

    Sizes are added up by ranges of time first, so that only the range where the cap falls is looked at row by row.
    """
    at = F.coalesce("used", "added")
    t = placed(items.withColumn("at", at), [F.desc("at")])
    newest = W.partitionBy("bucket").orderBy(F.desc("at"), "id").rowsBetween(W.unboundedPreceding, 0)
    whole = t.groupBy("bucket").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return t.join(whole.select("bucket", before.alias("held")), "bucket").withColumn("total", F.col("held") + F.sum("size").over(newest)).filter(F.col("total") > cap).select(*items.columns)


def undo_latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the value that its latest change replaced: the log (keys, at, id, before) is only ever added to."""
    last = F.max_by("before", F.struct("at", "id")).alias("value")
    return log.groupBy(*keys).agg(last)


def backfilled(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's rows that it doesn't have by key; doing it again adds nothing."""
    new = source.select(*target.columns).dropDuplicates(keys).alias("s")
    match = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return target.unionByName(new.join(target.alias("t"), match, "left_anti"))
