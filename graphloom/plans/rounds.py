"""Written tables between the rounds of an iteration, and ranks over a whole table without a single task.

A round is one job: it writes its rows and returns what the loop asks of them, so that nothing is computed twice and
a lost executor costs its own tasks only. What a later round doesn't read any more is deleted.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


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


class Round:
    """A table written by one job, and the aggregates that were asked of its rows."""

    def __init__(self, df: DataFrame, tag: str, keep: list[str] | None = None, **metrics: Column):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
        seen = Observation() if metrics else None
        out = df.observe(seen, *(v.alias(k) for k, v in metrics.items())) if seen else df
        out = out.select(*keep) if keep else out
        out.write.parquet(self.path)
        self.metrics = seen.get if seen else {}
        self.table = self.spark.read.schema(out.schema).parquet(self.path)

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    return Round(df, tag).table


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt over all cores where it has fewer splits than there are of them; else as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def placed(df: DataFrame, order: list[Column], within: tuple[str, ...] = (), tag: str = "placed") -> DataFrame:
    """The rows with ``bucket`` and ``before``: the rows of the same group in the buckets before it.

    Rows are dealt by ranges of (group, order), so a bucket is sorted on its own and a rank is ``before`` plus the rank
    in the bucket, whatever a group's size. Equal values share a bucket.
    """
    keys = [F.col(c) for c in within]
    rows = written(df.repartitionByRange(*keys, *order).withColumn("bucket", F.spark_partition_id()), tag)
    counts = rows.groupBy(*within, "bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition and group
    earlier = W.partitionBy(*within).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*within, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = rows.alias("d").join(offsets.alias("o"), [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*within, "bucket")])
    return joined.select("d.*", "o.before")


def ordinal(df: DataFrame, order: list[Column], ties: list[str], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Ranks 1 to n by ``order`` and then ``ties``; ranges are cut by both, so rows of one value may be in many."""
    own = W.partitionBy(*within, "bucket").orderBy(*order, *ties)
    p = placed(df, [*order, *map(F.col, ties)], within)
    return p.withColumn(name, F.col("before") + F.row_number().over(own)).drop("bucket", "before")


def fractional(df: DataFrame, value: str, name: str, higher_is_better: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1 with ties averaged; null of null."""
    order = F.desc_nulls_last(value) if higher_is_better else F.asc_nulls_last(value)
    own = W.partitionBy(*within, "bucket")
    peers = F.count(F.lit(1)).over(W.partitionBy(*within, "bucket", value))
    rank = F.col("before") + F.rank().over(own.orderBy(order)) + (peers - 1) / 2
    return placed(df, [order], within).withColumn(name, F.when(F.col(value).isNotNull(), rank)).drop("bucket", "before")
