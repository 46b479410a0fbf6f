"""Keyed streaming state with timers, and a sink that a repeated batch doesn't double."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.plans.rounds import shared_dir, written
from graphloom.registry import query
from graphloom.session import table
from graphloom.streaming.windows import windowed_counts

RUNS = 3_600_000_000  # microseconds that a job takes
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DECISIONS = "job long, event_id long, started boolean, running long"


class OneInFlight(StatefulProcessor):
    """Of the requests of a key, one runs at a time: state is the running request and its time.

    A request after the running one's end starts, whether its timer has fired or not; the timer drops the state of keys
    that have no more requests, so it is bounded by what runs. Rows of a key in one micro-batch are taken in the order
    of time. One that comes before the running request's start is refused.
    """

    def __init__(self, runs: int):
        self.runs = runs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "since long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.running.get() if self.running.exists() else None
        batch = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        ids, started, running = [], [], []
        before = held
        for t, event in zip(batch["t"].tolist(), batch["event_id"].tolist(), strict=True):
            start = held is None or t - held[0] >= self.runs
            held = (t, event) if start else held
            ids.append(event)
            started.append(start)
            running.append(held[1])
        if held is not None and held != before:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((held[0] + self.runs) // 1000 + 1)
            self.running.update(held)
        yield pd.DataFrame({"job": key[0], "event_id": ids, "started": started, "running": running})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.running.clear()
        return iter([])

    def close(self) -> None:
        pass


def one_in_flight(stream: DataFrame, delay: str = "1 hour", runs: int = RUNS) -> DataFrame:
    """job, event_id, started, running (the request that runs) of requests job, event_id, ts.

    Rows older than the watermark are dropped. The session needs the RocksDB state store (STATE_STORE).
    """
    rows = stream.withWatermark("ts", delay).select("job", "event_id", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("job").transformWithStateInPandas(OneInFlight(runs), DECISIONS, outputMode="append", timeMode="eventTime")


def put_batch(df: DataFrame, batch: int, root: str) -> None:
    """Writes a micro-batch to the folder of its number: a batch that is run again replaces itself."""
    df.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def drained(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds; the rows put out, with their batch."""
    spark, schema = stream.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(lambda df, n: put_batch(df, n, f"{root}/out")).start()
    q.awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{root}/out")


def streamed_files(df: DataFrame, files: int, by: str, root: str) -> DataFrame:
    """A stream over the rows, dealt by a key to so many files, which come one in each micro-batch, in no order of time."""
    spark = df.sparkSession
    df.repartition(files, by).write.mode("overwrite").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stm_stream_counts", "SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day of all closed days, from files that come in no order of time: the watermark's delay is longer than they are apart."""
    root = new_root(spark)
    e = events(spark, sf).select("event_type", "ts")
    last = e.agg(F.date_trunc("day", F.max("ts"))).first()[0]
    close = e.agg(F.max("event_type").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    stream = streamed_files(e, 4, "event_type", root)
    close.write.mode("append").parquet(f"{root}/in")  # a row so much later that its watermark closes the windows before
    out = drained(windowed_counts(stream, "ts", "event_type", "1 day", "60 days"), root)
    return out.filter(F.col("start") < F.lit(last)).select("event_type", F.unix_seconds("start").alias("start"), "n")


@query("stm_stream_one_in_flight", """WITH RECURSIVE e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS job, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY json_extract(props, '$.k') ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT job, event_id, k, t AS since, event_id AS running, true AS started FROM e WHERE k = 1 UNION ALL SELECT e.job, e.event_id, e.k, CASE WHEN e.t - r.since >= 3600000000 THEN e.t ELSE r.since END, CASE WHEN e.t - r.since >= 3600000000 THEN e.event_id ELSE r.running END, e.t - r.since >= 3600000000 FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1)
SELECT job, event_id, started, running FROM r""")
def stream_one_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of jobs as a stream of files by job: which start, and which are told of the one that runs."""
    old = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        root = new_root(spark)
        e = events(spark, sf).select(F.get_json_object("props", "$.k").cast("long").alias("job"), "event_id", "ts")
        return written(drained(one_in_flight(streamed_files(e, 4, "job", root), "60 days"), root).drop("batch"), "in-flight")
    finally:
        if old is None:
            spark.conf.unset(STATE_STORE[0])
        else:
            spark.conf.set(STATE_STORE[0], old)
