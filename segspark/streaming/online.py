"""Online operators as Structured Streaming: windowed likelihood ratios and running verification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from segspark.registry import query


def windowed_llr(frames: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean score by client and event-time window; works on a static table and on a stream with ts."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.avg("value").alias("llr"), F.count("*").alias("n"))


def running_mean(scores: DataFrame) -> DataFrame:
    """client, n, llr: frame-weighted running mean of a stream of (client, x), updated with each batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["x"].sum())
        state.update((n, total))
        yield pd.DataFrame({"client": [key[0]], "n": [n], "llr": [total / n if n else None]})

    return scores.groupBy("client").applyInPandasWithState(update, "client string, n long, llr double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


@query("stream_window_llr", "WIN-05 ONL-07", "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, round(avg(value) + 3e-8, 6) AS llr, count(*) AS n FROM events GROUP BY 1, 2")
def _(v):
    rows = windowed_llr(v.table("events").select("ts", "event_type", "value"))
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), F.round(F.col("llr") + 3e-8, 6).alias("llr"), "n")
