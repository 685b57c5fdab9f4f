"""Who is in the experiment: first exposures, arm integrity, triggers, uptake and the assignment ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.scalar import local_date


def enrolling_rows(rows: DataFrame, experiment: str | None, start: str | None = None, end: str | None = None, offset_minutes: int = 0) -> DataFrame:
    """Rows inside the experiment's window that belong to it; if no row carries a key, every row does."""
    ds = local_date(F.col("ts"), offset_minutes)
    out = rows.filter(F.col("unit_id").isNotNull())
    if start:
        out = out.filter(ds >= F.lit(start).cast("date"))
    if end:
        out = out.filter(ds <= F.lit(end).cast("date"))
    if experiment is not None and "experiment_id" in rows.columns:
        keys = out.agg(F.count_if(F.col("experiment_id").isNotNull()).alias("keyed"), F.count_if(F.col("experiment_id") == experiment).alias("own")).first()
        if keys.keyed and not keys.own:
            some = [r[0] for r in out.select("experiment_id").filter("experiment_id IS NOT NULL").distinct().limit(5).collect()]
            raise EngineError("source.experiment_key_unmatched", f"no row of {experiment!r}", keys=some)
        if keys.keyed:
            out = out.filter(F.col("experiment_id") == experiment)
    return out


def first_exposures(rows: DataFrame, experiment: str | None = None, start: str | None = None, end: str | None = None, *, mixed: str = "exclude", offset_minutes: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per unit: its first exposure, the arm of that row (of equal times, the smallest), and ``carry`` columns of it.

    Units seen in several arms are ``mixed``: excluded, refused ("error"), or kept with their first arm ("keep").
    """
    scoped = enrolling_rows(rows, experiment, start, end, offset_minutes)
    first = F.min(F.struct("ts", "group_id", *carry))
    arms = F.count_distinct("group_id") + F.max(F.col("group_id").isNull().cast("int"))
    units = scoped.groupBy("unit_id").agg(first.alias("first"), arms.alias("arms"))
    if mixed == "error":
        bad = units.filter("arms > 1").count()
        if bad:
            raise EngineError("exposures.mixed_assignment", f"{bad} units in several arms", units=bad)
    if mixed != "keep":
        units = units.filter("arms = 1 AND first.group_id IS NOT NULL")
    ts = F.col("first.ts")
    return units.select(F.lit(experiment).cast("string").alias("experiment_id"), "unit_id", F.col("first.group_id").alias("group_id"), ts.alias("first_exposure_ts"), local_date(ts, offset_minutes).alias("first_exposure_date"), *(F.col(f"first.{c}").alias(c) for c in carry))


def mixed_assignment_snapshot(rows: DataFrame) -> DataFrame:
    """One row: units, units in several arms, rows without an arm."""
    units = rows.groupBy("unit_id").agg(F.count_distinct("group_id").alias("arms"), F.count_if(F.col("group_id").isNull()).alias("no_arm"))
    return units.agg(F.count("*").alias("units"), F.count_if(F.col("arms") > 1).alias("mixed_units"), F.coalesce(F.sum("no_arm"), F.lit(0)).alias("null_arm_rows"))


def arm_counts(exposures: DataFrame) -> DataFrame:
    return exposures.groupBy("group_id").agg(F.count("*").alias("n"))


def validate_clusters(exposures: DataFrame, cluster: str) -> DataFrame:
    """Clusters seen in several arms."""
    return exposures.groupBy(cluster).agg(F.count_distinct("group_id").alias("arms")).filter("arms > 1")


def cluster_exposure_counts(exposures: DataFrame, cluster: str) -> DataFrame:
    return exposures.groupBy("group_id").agg(F.count_distinct(cluster).alias("n_clusters"), F.count("*").alias("n_units"))


def daily_exposure_counts(exposures: DataFrame) -> DataFrame:
    """Per day and arm, on the whole grid: new and cumulative units (a row per day and arm: the windows are narrow)."""
    seen = exposures.groupBy(F.col("first_exposure_date").alias("ds"), "group_id").agg(F.count("*").alias("n"))
    arms = exposures.select("group_id").distinct()
    edge = exposures.agg(F.min("first_exposure_date").alias("a"), F.max("first_exposure_date").alias("b"))
    days = edge.select(F.explode(F.sequence("a", "b")).alias("ds"))
    grid = days.crossJoin(F.broadcast(arms))
    full = grid.join(seen, ["ds", "group_id"], "left").select("ds", "group_id", F.coalesce("n", F.lit(0)).alias("n_daily"))
    order = Window.partitionBy("group_id").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("n_cumulative", F.sum("n_daily").over(order))


def triggered_population(exposures: DataFrame, triggers: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Exposed units with their first trigger at or after assignment, and no later than ``cutoff``."""
    hits = triggers.filter(F.col("unit_id").isNotNull())
    if cutoff:
        hits = hits.filter(F.col("ts") <= F.lit(cutoff).cast("timestamp"))
    joined = exposures.join(hits.select("unit_id", F.col("ts").alias("trigger_ts")), "unit_id").filter(F.col("trigger_ts") >= F.col("first_exposure_ts"))
    keys = ["experiment_id", "unit_id", "group_id", "first_exposure_ts", "first_exposure_date"]
    return joined.groupBy(*keys).agg(F.min("trigger_ts").alias("first_trigger_ts"))


def trigger_rates(exposures: DataFrame, triggered: DataFrame) -> DataFrame:
    both = exposures.join(triggered.select("unit_id", F.lit(1).alias("hit")), "unit_id", "left")
    return both.groupBy("group_id").agg(F.count("*").alias("n_exposed"), F.count("hit").alias("n_triggered"), (F.count("hit") / F.count("*")).alias("rate"))


def uptake(exposures: DataFrame, uptake_events: DataFrame, window_days: int | None = None, offset_minutes: int = 0) -> DataFrame:
    """``exposures`` with d: 1 for a unit with an uptake event at or after exposure, within ``window_days`` if given."""
    joined = exposures.select("unit_id", "first_exposure_ts", "first_exposure_date").join(uptake_events.select("unit_id", "ts"), "unit_id").filter(F.col("ts") >= F.col("first_exposure_ts"))
    if window_days is not None:
        joined = joined.filter(F.date_diff(local_date(F.col("ts"), offset_minutes), F.col("first_exposure_date")) < window_days)
    taken = joined.select("unit_id").distinct().withColumn("_hit", F.lit(1))
    return exposures.join(taken, "unit_id", "left").withColumn("d", F.coalesce("_hit", F.lit(0)).cast("double")).drop("_hit")


def compliance(exposed: DataFrame) -> DataFrame:
    return exposed.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("d").alias("takers"), F.avg("d").alias("uptake"))


def reduce_ledger(rows: DataFrame) -> DataFrame:
    """Latest version of each (experiment_id, unit_id, period)."""
    keys = ["experiment_id", "unit_id", "period"]
    return rows.groupBy(*keys).agg(F.max_by("group_id", F.struct("version", "group_id")).alias("group_id"), F.max("version").alias("version"))


def ledger_exposures(ledger: DataFrame) -> DataFrame:
    """Each assignment period with the arm of the following one."""
    order = Window.partitionBy("experiment_id", "unit_id").orderBy("period")
    return ledger.withColumn("next_group_id", F.lead("group_id").over(order))


def check_roster(exposures: DataFrame, roster: DataFrame) -> DataFrame:
    """One row: roster units, duplicates, roster units not enrolled, enrolled units not on the roster."""
    units = roster.groupBy("unit_id").agg(F.count("*").alias("times"))
    both = units.join(exposures.select("unit_id", F.lit(1).alias("enrolled")), "unit_id", "full_outer")
    return both.agg(F.count("times").alias("roster_units"), F.count_if(F.col("times") > 1).alias("duplicates"), F.count_if(F.col("times").isNotNull() & F.col("enrolled").isNull()).alias("not_enrolled"), F.count_if(F.col("times").isNull()).alias("not_on_roster"))
