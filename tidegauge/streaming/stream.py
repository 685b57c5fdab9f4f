"""Structured Streaming twins of the batch operators; each takes a streaming (or batch) frame of (unit_id, ts, event, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import moments as M


def read_events(spark: SparkSession, path: str, schema: str = "unit_id string, ts timestamp, event string, value double", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_totals(events: DataFrame, event: str, window: str = "1 day", late: str = "2 days", start: str | None = None) -> DataFrame:
    """Per window: events, sum, minimum and maximum; rows later than the watermark are dropped, as after a data edge."""
    own = events.filter(F.col("event") == event).withWatermark("ts", late)
    w = F.window("ts", window, startTime=start) if start else F.window("ts", window)
    return own.groupBy(w).agg(F.count("*").alias("n_events"), F.sum("value").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).select(F.col("window.start").alias("period"), "n_events", "sum_value", "min_value", "max_value")


def rolling_active(events: DataFrame, event: str, days: int = 7, late: str = "2 days") -> DataFrame:
    """Distinct units in trailing windows, by a sketch: a stream keeps no exact distinct over sliding windows."""
    own = events.filter(F.col("event") == event).withWatermark("ts", late)
    g = own.groupBy(F.window("ts", f"{days} days", "1 day")).agg(F.approx_count_distinct("unit_id", 0.01).alias("value"))
    return g.select(F.date_sub(F.to_date("window.end"), 1).alias("period_end"), "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    own = events.withWatermark("ts", late)
    return own.groupBy(F.session_window("ts", gap), "unit_id").agg(F.count("*").alias("n_events")).select("unit_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def unique_events(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def first_exposures(rows: DataFrame, late: str = "3650 days") -> DataFrame:
    """A row per unit when its first exposure is seen; input (unit_id, ts, group_id) in any order within the watermark.

    Custom state: the earliest (ts, arm) so far; an earlier row that arrives later is written again with ``revision`` up.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, revision = (state.get[0:2], state.get[2]) if state.exists else (None, -1)
        seen = best
        for f in frames:
            r = f.sort_values(["ts", "group_id"]).iloc[0]
            now = (r["ts"].isoformat(), r["group_id"])
            best = now if best is None or now < tuple(best) else best
        if seen is None or tuple(best) != tuple(seen):
            state.update((best[0], best[1], revision + 1))
            yield pd.DataFrame({"unit_id": [key[0]], "group_id": [best[1]], "first_exposure_ts": [pd.Timestamp(best[0])], "revision": [revision + 1]})

    return rows.select("unit_id", "ts", "group_id").groupBy("unit_id").applyInPandasWithState(
        update, "unit_id string, group_id string, first_exposure_ts timestamp, revision int", "ts string, group_id string, revision int", "update", "NoTimeout")


def into_moments(values: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's moments of ``values`` (keys, y) become one part of a moment table, written under its batch number:
    a batch that is run again overwrites its part, so every row counts once; `current_moments` merges the parts."""

    def write(batch: DataFrame, number: int) -> None:
        M.group_summary(batch, keys).write.mode("overwrite").parquet(f"{path}/part={number}")

    return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_moments(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return M.merge(spark.read.parquet(path), keys)


def compact(spark: SparkSession, path: str, keys: list[str], into: str) -> DataFrame:
    """The parts merged into one table, so that a long stream's state stays as large as its keys."""
    current_moments(spark, path, keys).write.mode("overwrite").parquet(f"{into}/part=0")
    return spark.read.parquet(into)
