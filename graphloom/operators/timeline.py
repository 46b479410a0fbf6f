"""Event and time operators: calendars, streaks, gaps, forecasts, decay, carry-forward and running marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.registry import query
from graphloom.session import table

AS_OF = "2024-01-31"
INTERVALS = (1, 3, 7, 21, 60)  # fixed values: days between reviews


def level(n):
    """0, 1, 2, 3 to 4, 5 and more, as levels 0 to 4."""
    return F.when(n >= 5, 4).when(n >= 3, 3).otherwise(n).cast("int")


@query("stm_activity_calendar", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n, CAST(CASE WHEN n >= 5 THEN 4 WHEN n >= 3 THEN 3 ELSE coalesce(n, 0) END AS INTEGER) AS level FROM u CROSS JOIN d LEFT JOIN c USING (user_id, day)""")
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user and day over 31 days, zero-filled; the grid is made from each user's own sequence of days."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.date_sub(F.lit(AS_OF).cast("date"), 30), F.lit(AS_OF).cast("date"))).alias("day"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")), ["user_id", "day"], "left").select("user_id", F.col("day").cast("string").alias("day"), n.alias("n"), level(n).alias("level"))


@query("win_daily_streak", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day, date_diff('day', DATE '2000-01-01', day) - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d), s AS (SELECT user_id, island, count(*) AS days, max(day) AS last_day FROM g GROUP BY 1, 2)
SELECT user_id, max(days) AS longest, arg_max(days, last_day) AS latest FROM s GROUP BY 1""")
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Longest and latest run of consecutive days."""
    d = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    g = d.withColumn("island", F.datediff("day", F.lit("2000-01-01").cast("date")) - F.row_number().over(W.partitionBy("user_id").orderBy("day")))
    s = g.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("days"), F.max("day").alias("last_day"))
    return s.groupBy("user_id").agg(F.max("days").alias("longest"), F.max_by("days", "last_day").alias("latest"))


@query("win_gaps", "WITH g AS (SELECT user_id, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) AS gap FROM events) SELECT user_id, count(*) FILTER (gap > 21600) AS pauses, round(max(gap), 3) AS longest FROM g GROUP BY 1")
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps to the next event over six hours, and the longest."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    g = table(spark, sf, "events").select("user_id", ((F.lead(t).over(W.partitionBy("user_id").orderBy("ts", "event_id")) - t) / 1e6).alias("gap"))
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") > 21600).alias("pauses"), F.round(F.max("gap"), 3).alias("longest"))


@query("win_latest_per_key", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row by key, as a map-side aggregated maximum."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("win_last_k_mean", "SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8) GROUP BY 1")
def last_k(spark: SparkSession, sf: str, k: int = 8) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf, "events").withColumn("rn", rn).filter(F.col("rn") <= k).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("win_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
def running_total(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@query("win_previous", "SELECT event_id, value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 999) AS improved FROM events")
def improved(spark: SparkSession, sf: str) -> DataFrame:
    prev = F.lag("value", 1).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", (F.col("value") > F.coalesce(prev, F.lit(999.0))).alias("improved"))


@query("win_high_water", "WITH w AS (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM events) SELECT event_id, mark, coalesce(value < mark * .5, false) AS tripped FROM w")
def high_water(spark: SparkSession, sf: str) -> DataFrame:
    """Running maximum of what came before, and whether a value falls below half of it."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    e = table(spark, sf, "events").select("event_id", "value", F.max("value").over(w).alias("mark"))
    return e.select("event_id", "mark", F.coalesce(F.col("value") < F.col("mark") * 0.5, F.lit(False)).alias("tripped"))


@query("win_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@query("win_share_of_total", "SELECT lang, source, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 9) AS share FROM documents GROUP BY lang, source")
def share(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("lang", "source", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 9).alias("share"))


@query("win_chunks", "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 8 AS chunk FROM part")
def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.floor((F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 8).alias("chunk"))


@query("win_trend_delta", """WITH m AS (SELECT o_orderpriority AS branch, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2)
SELECT branch, CAST(month AS VARCHAR) AS month, round(mean - lag(mean) OVER (PARTITION BY branch, month >= DATE '1996-01-01' ORDER BY month), 3) AS delta FROM m""")
def trend_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Change against the previous snapshot of the same branch and version."""
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("branch"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    w = W.partitionBy("branch", F.col("month") >= F.lit("1996-01-01").cast("date")).orderBy("month")
    return m.select("branch", F.col("month").cast("string").alias("month"), F.round(F.col("mean") - F.lag("mean").over(w), 3).alias("delta"))


DUE_SQL = "due AS (SELECT user_id, event_id, ts + to_days(CAST([1, 3, 7, 21, 60][1 + event_id % 5] AS INTEGER)) AS due_at, [1, 3, 7, 21, 60][1 + event_id % 5] AS days FROM events)"


def due(spark: SparkSession, sf: str) -> DataFrame:
    days = F.get(F.array(*map(F.lit, INTERVALS)), (F.col("event_id") % 5).cast("int"))
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), days.alias("days"))
    return e.select("user_id", "event_id", "days", (F.col("ts") + F.make_dt_interval("days")).alias("due_at"))


@query("stm_due_forecast", f"""WITH {DUE_SQL}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-31', DATE '2024-02-06', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM d LEFT JOIN due ON greatest(CAST(due_at AS DATE), DATE '2024-01-31') = day GROUP BY 1""")
def forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Due by day for a week, overdue counted today, zero-filled."""
    today = F.lit(AS_OF).cast("date")
    n = due(spark, sf).groupBy(F.greatest(F.to_date("due_at"), today).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1).select(F.explode(F.sequence(today, F.date_add(today, 6))).alias("day"))
    return grid.join(n, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("date_memory_strength", f"WITH {DUE_SQL} SELECT event_id, round(CASE WHEN due_at >= TIMESTAMP '2024-01-31' THEN 1.0 ELSE greatest(.15, 1 - epoch(TIMESTAMP '2024-01-31' - due_at) / (1.5 * days * 86400)) END, 6) AS strength FROM due")
def strength(spark: SparkSession, sf: str) -> DataFrame:
    """1 until due, then down to .15 over one and a half intervals."""
    over = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("due_at") / 1e6
    return due(spark, sf).select("event_id", F.round(F.when(over <= 0, 1.0).otherwise(F.greatest(F.lit(0.15), 1 - over / (1.5 * F.col("days") * 86400))), 6).alias("strength"))


@query("stm_review_summary", f"WITH {DUE_SQL} SELECT user_id, count(*) FILTER (due_at <= TIMESTAMP '2024-01-31') AS due, count(*) AS items FROM due GROUP BY 1")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return due(spark, sf).groupBy("user_id").agg(F.count_if(F.col("due_at") <= F.lit(AS_OF).cast("timestamp")).alias("due"), F.count(F.lit(1)).alias("items"))


@query("stm_buckets", "SELECT event_type, CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows of six hours."""
    e = table(spark, sf, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n")


@query("date_elapsed_days", "SELECT o_orderkey, CAST(floor(epoch(TIMESTAMP '2024-01-31' - o_orderdate) / 86400) AS BIGINT) AS days FROM orders")
def elapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days of elapsed time, not calendar boundaries."""
    return table(spark, sf, "orders").select("o_orderkey", F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6) / 86400).alias("days"))


def throttled(rows: DataFrame, key: str, micros: str, gap: int) -> DataFrame:
    """The rows with ``passed``: the first of a key, each that is ``gap`` after the last one passed, and the key's last.

    Which rows pass depends on those before, so a key's rows stream by in order; a task holds one row.
    """
    kept = [c for c in rows.columns]
    own = W.partitionBy(key).orderBy(micros)
    marked = rows.withColumn("passed", F.lead(micros).over(own).isNull())
    at, by, last = kept.index(micros), kept.index(key), len(kept)

    def run(batches):
        import pyarrow as pa

        before, since = None, None
        for batch in batches:
            keys, times = batch.column(by).to_pylist(), batch.column(at).to_pylist()
            passed = batch.column(last).to_pylist()
            for i, (k, t) in enumerate(zip(keys, times, strict=True)):
                if since is None or k != before or t - since >= gap:
                    passed[i], since = True, t
                before = k
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(passed, pa.bool_())], [*kept, "passed"])

    return marked.repartition(key).sortWithinPartitions(key, micros).mapInArrow(run, marked.schema)


@query("stm_throttled_progress", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, event_id, k, n, t AS since, true AS passed FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, e.n, CASE WHEN e.t - r.since >= 21600000000 THEN e.t ELSE r.since END, e.t - r.since >= 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, count(*) FILTER (passed OR k = n) AS emitted, count(*) AS total FROM r GROUP BY 1""")
def throttled_progress(spark: SparkSession, sf: str, gap: int = 21_600_000_000) -> DataFrame:
    """How many of a job's reports go out when they may come no closer than six hours; the last always does."""
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return throttled(e, "user_id", "t", gap).groupBy("user_id").agg(F.count_if("passed").alias("emitted"), F.count(F.lit(1)).alias("total"))


@query("stm_one_in_flight", """WITH RECURSIVE e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS job, epoch_us(ts) AS t, row_number() OVER (PARTITION BY json_extract(props, '$.k') ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT job, k, t AS since, true AS started FROM e WHERE k = 1 UNION ALL SELECT e.job, e.k, CASE WHEN e.t - r.since >= 3600000000 THEN e.t ELSE r.since END, e.t - r.since >= 3600000000 FROM r JOIN e ON e.job = r.job AND e.k = r.k + 1)
SELECT job, count(*) FILTER (started) AS started, count(*) FILTER (NOT started) AS refused FROM r GROUP BY 1""")
def one_in_flight(spark: SparkSession, sf: str, runs: int = 3_600_000_000) -> DataFrame:
    """Jobs that take an hour each: a request while one of its key runs is refused."""
    e = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("long").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lit(False).alias("done"))
    # The last row always passes in throttled(), so whether it would have passed by itself is told by a row after it.
    ends = e.groupBy("job").agg((F.max("t") + 1).alias("t")).withColumn("done", F.lit(True))
    t = throttled(e.unionByName(ends), "job", "t", runs).filter("not done")
    return t.groupBy("job").agg(F.count_if("passed").alias("started"), F.count_if(~F.col("passed")).alias("refused"))
