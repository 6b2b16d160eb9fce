"""Streaming forms of media windows over a stream of events (extensions: the batch forms are in ``operators.media``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, with the event time as a timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per kind of event and window; rows later than the watermark are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions per user that end with a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def capped_sessions(events: DataFrame, gap_sec: float, longest_sec: float, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions that end with a gap or before they would last longer than ``longest_sec``.

    The rule depends on the path, so the open session of each user is state; a timeout by the watermark closes it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            done.append(state.get)
            state.remove()
        else:
            times = sorted(t.timestamp() for b in batches for t in b["ts"])
            start, end, n = state.get if state.exists else (None, None, 0)
            for t in times:
                if start is None:
                    start, end, n = t, t, 1
                elif t - end > gap_sec or t - start > longest_sec:
                    done.append((start, end, n))
                    start, end, n = t, t, 1
                else:
                    end, n = max(end, t), n + 1
            state.update((start, end, n))
            state.setTimeoutTimestamp(int((end + gap_sec) * 1000) + 1)
        yield pd.DataFrame([(key[0], pd.Timestamp(s, unit="s"), pd.Timestamp(e, unit="s"), c) for s, e, c in done], columns=["user_id", "start", "end", "n"])

    return (
        events.withWatermark("ts", late)
        .groupBy("user_id")
        .applyInPandasWithState(run, "user_id bigint, start timestamp, end timestamp, n bigint", "start double, end double, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )
