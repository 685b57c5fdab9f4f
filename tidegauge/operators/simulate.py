"""Synthetic experiments by seeded columns over `spark.range`: every row's draws depend on its id and the seed alone."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """(0, 1) from a hash of the keys: the same on any partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(6.283185307179586 * uniform(seed + 7919, *keys))


def raw_logs(spark: SparkSession, units: int, days: int = 14, *, start: str = "2025-01-01", lift: float = 0.0, rate: float = 0.3, seed: int = 1, share: float = 0.5) -> DataFrame:
    """(unit_id, ts, event, value, group_id): an exposure per unit on a random day, then purchases at a rate per day."""
    u = spark.range(units).withColumn("group_id", F.when(uniform(seed, F.col("id")) < share, "treatment").otherwise("control"))
    u = u.withColumn("first", F.floor(uniform(seed + 1, F.col("id")) * days).cast("int"))
    origin = F.unix_timestamp(F.lit(start).cast("timestamp"))
    at = lambda day, second: F.timestamp_seconds(origin + day * 86400 + second)
    exposed = u.select(F.col("id").cast("string").alias("unit_id"), at(F.col("first"), F.floor(uniform(seed + 2, F.col("id")) * 40000)).alias("ts"), F.lit("exposure").alias("event"), F.lit(None).cast("double").alias("value"), "group_id")
    day = u.select("*", F.explode(F.sequence(F.col("first"), F.lit(days - 1))).alias("day")).filter(uniform(seed + 3, F.col("id"), F.col("day")) < rate)
    value = F.exp(0.5 * normal(seed + 4, F.col("id"), F.col("day"))) * F.when(F.col("group_id") == "treatment", 1 + lift).otherwise(1.0)
    bought = day.select(F.col("id").cast("string").alias("unit_id"), at(F.col("day"), 50000 + F.floor(uniform(seed + 5, F.col("id"), F.col("day")) * 30000)).alias("ts"), F.lit("purchase").alias("event"), value.alias("value"), "group_id")
    return exposed.unionByName(bought)


def clustered_units(spark: SparkSession, clusters: int, size: int, *, effect: float = 0.0, icc: float = 0.1, seed: int = 1) -> DataFrame:
    """(unit_id, cluster_id, group_id, y): clusters share a normal component."""
    u = spark.range(clusters * size).withColumn("cluster_id", (F.col("id") / size).cast("long"))
    arm = F.when(uniform(seed, F.col("cluster_id")) < 0.5, "control").otherwise("treatment")
    y = 10 + icc**0.5 * normal(seed + 1, F.col("cluster_id")) + (1 - icc) ** 0.5 * normal(seed + 2, F.col("id")) + F.when(arm == "treatment", effect).otherwise(0.0)
    return u.select(F.col("id").cast("string").alias("unit_id"), F.col("cluster_id").cast("string").alias("cluster_id"), arm.alias("group_id"), y.alias("y"))


def switchback_steps(spark: SparkSession, units: int, cycles: int, steps: int, *, effect: float = 0.0, seed: int = 1) -> DataFrame:
    """(unit_id, cycle, period, step, order, value): two periods a cycle in a random order of control and treatment."""
    n = spark.range(units * cycles * 2 * steps)
    i = F.col("id")
    cols = n.select(F.floor(i / (cycles * 2 * steps)).alias("unit"), F.pmod(F.floor(i / (2 * steps)), F.lit(cycles)).alias("cycle"), F.pmod(F.floor(i / steps), F.lit(2)).cast("int").alias("period"), F.pmod(i, F.lit(steps)).cast("int").alias("step"))
    order = F.when(uniform(seed, F.col("unit"), F.col("cycle")) < 0.5, "CT").otherwise("TC")
    treated = (order == "CT") == (F.col("period") == 1)
    value = normal(seed + 1, F.col("unit")) + normal(seed + 2, F.col("unit"), F.col("cycle"), F.col("period"), F.col("step")) + F.when(treated, effect / steps).otherwise(0.0)
    return cols.select(F.col("unit").cast("string").alias("unit_id"), "cycle", "period", "step", order.alias("order"), value.alias("value"))


def logged_run(spark: SparkSession, units: int, horizon: int, actions: list[str], *, best: str, gain: float = 0.5, seed: int = 1) -> DataFrame:
    """(unit_id, t, context, action, propensity, reward): a uniform logger; the best action adds to the reward."""
    n = spark.range(units * horizon).select(F.floor(F.col("id") / horizon).alias("u"), (F.pmod("id", F.lit(horizon)) + 1).cast("int").alias("t"))
    pick = F.element_at(F.array(*map(F.lit, actions)), (F.floor(uniform(seed, F.col("u"), F.col("t")) * len(actions)) + 1).cast("int"))
    return n.select(F.col("u").cast("string").alias("unit_id"), "t", F.pmod("u", F.lit(2)).cast("int").alias("context"), pick.alias("action"), F.lit(1 / len(actions)).alias("propensity"), (normal(seed + 1, F.col("u"), F.col("t")) * 0.1 + F.when(pick == best, gain).otherwise(0.0)).alias("reward"))


def replicate(spark: SparkSession, times: int, one: Callable[[int], dict], schema: str) -> DataFrame:
    """A Monte Carlo study: ``one(seed)`` on the executors, a row per replicate."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"replicate": int(i), **one(int(i))} for i in frame["id"]])

    parts = max(1, min(times, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(times).withColumn("part", F.pmod("id", F.lit(parts))).groupBy("part").applyInPandas(run, f"replicate long, {schema}")
