"""Shared pieces: words as Spark expressions, materialised tables, and ranks inside hot groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The white space that separates words, as characters and as a class.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def whole_text(c: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words (maximal runs of characters other than BLANKS) of a non-null text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def let(value: Column, body) -> Column:
    """Binds a computed value to a lambda variable, so that a body that uses it often computes it once."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one on a local master (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote; for those that only written tables were made of."""
    for t in tables:
        known, path = _paths.pop(id(t), (None, None))
        if known and known() is t:
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rows_of(docs: DataFrame, **more: str | Column) -> DataFrame:
    """Every row as one struct ``row``, and further columns beside it: no name of the input's can clash with them."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), *((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in more.items()))


def same(a: str, b: str, columns: list[str]) -> Column:
    """Null-safe equality of the columns of two aliased tables."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def rank_in_groups(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, per_bucket: int = 4096) -> DataFrame:
    """Adds a 0-based rank within each key, also where one key holds a third of all rows.

    Rows are ordered by (order mod n, order, ties), where n grows with the key's count: each key is dealt over n
    buckets, counts of the buckets give their offsets, and only a bucket of about per_bucket rows is ever sorted.
    ``order`` is a long, usually a seeded hash. Null keys are a group of their own.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    dealt = (
        df.alias("d").join(counts.alias("c"), same("d", "c", keys)).select("d.*", F.col("c.__n"))
        .withColumn("__b", F.pmod(F.col(order), F.ceil(F.col("__n") / per_bucket))).drop("__n")
    )
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__m")).withColumn("__o", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    own = W.partitionBy(*keys, "__b").orderBy(order, *ties)
    ranked = dealt.withColumn("__r", F.row_number().over(own) - 1)
    return ranked.alias("d").join(offsets.alias("c"), same("d", "c", [*keys, "__b"])).select("d.*", F.col("c.__o")).withColumn(out, F.col("__r") + F.col("__o")).drop("__r", "__b", "__o")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], tag: str) -> DataFrame:
    """Adds sums over the rows that come before, by name; no task has more than a range of the rows.

    Rows are dealt by ranges of ``order``, which must tell all rows apart; a range's sum is one row for each task.
    """
    values = {f"__v{k}": c for k, c in enumerate(sums.values())}
    dealt = df.select("*", *(c.alias(v) for v, c in values.items())).repartitionByRange(*order).withColumn("__b", F.spark_partition_id())
    dealt = materialize(dealt, tag)
    earlier = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there were tasks
    before = dealt.groupBy("__b").agg(*(F.sum(v).alias(v) for v in values)).select("__b", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}b") for v in values))
    own = W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(F.broadcast(before), "__b").select(*df.columns, *((F.col(f"{v}b") + F.coalesce(F.sum(v).over(own), F.lit(0))).alias(name) for name, v in zip(sums, values, strict=True)))
