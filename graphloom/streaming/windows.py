"""Structured Streaming forms: windowed counts with late data, deduplication within a watermark, and a keyed fold.

Late means: older than the watermark, the latest event time seen less the delay. Late rows don't change a window that
is already closed; rows that are late by less than the delay do. State is dropped with the watermark, so it is bounded
by what arrives within the delay, but the fold's, which is one row a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PASS = 70
LAST_INTERVAL = 4


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """key, start, n: tumbling counts; append mode emits each window once, when the watermark passes its end."""
    w = stream.withWatermark(ts, delay).groupBy(F.col(key), F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """key, start, end, n: runs of events without a gap."""
    w = stream.withWatermark(ts, delay).groupBy(F.col(key), F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_by_hash(stream: DataFrame, ts: str, content: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each content within the delay; only digests are kept as state."""
    hashed = stream.withColumn("content_sha256", F.sha2(F.coalesce(content, F.lit("")), 256)).withWatermark(ts, delay)
    return hashed.dropDuplicatesWithinWatermark(["content_sha256"])


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    step = state.get[0] if state.exists else 0
    n = state.get[1] if state.exists else 0
    # A key's rows of one micro-batch are ordered together; their scores and times are all that is held.
    for score in pd.concat(list(batches)).sort_values("ts", kind="stable")["score"]:
        step = min(LAST_INTERVAL, step + 1) if score >= PASS else 0
        n += 1
    state.update((step, n))
    yield pd.DataFrame({"user_id": [key[0]], "step": [step], "reviews": [n]})


def review_steps(stream: DataFrame) -> DataFrame:
    """user_id, step, reviews: a pass goes one interval on, a failure to the start; from user_id, ts, score."""
    rows = stream.select("user_id", "ts", "score")
    return rows.groupBy("user_id").applyInPandasWithState(_fold, "user_id long, step int, reviews long", "step int, n long", "update", GroupStateTimeout.NoTimeout)
