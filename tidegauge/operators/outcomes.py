"""From events to a number per unit: unit-day statistics, windows, censoring, totals, covariates, winsorization.

The dense unit-by-day spine is never built for totals: zero days add nothing to sums and counts, and the windows are
inequalities on the day offset; `panel` builds it where a dense panel is the result asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.scalar import local_date

AGGREGATIONS = ("sum", "count", "count_distinct", "avg_event", "avg_calendar_day", "min", "max")
_ZERO = ("sum", "count", "count_distinct", "avg_calendar_day", "conversion")
_OPS = {
    "equals": lambda c, v: c == v[0], "not_equals": lambda c, v: c != v[0], "lt": lambda c, v: c < v[0], "lte": lambda c, v: c <= v[0],
    "gt": lambda c, v: c > v[0], "gte": lambda c, v: c >= v[0], "in": lambda c, v: c.isin(*v),
}


@dataclass(frozen=True)
class Outcome:
    """kind: mean, conversion or retention; window: days [0, window); band: retention days [a, b), b None for no end."""

    kind: str = "mean"
    aggregation: str = "sum"
    window: int | None = None
    band: tuple[int, int | None] | None = None

    def __post_init__(self):
        if self.kind == "mean" and self.aggregation not in AGGREGATIONS:
            raise EngineError("metric.unknown_aggregation", f"{self.aggregation!r}", aggregation=self.aggregation)
        if self.kind == "retention" and self.band is None:
            raise EngineError("metric.retention_band", "retention needs a band of days")

    @property
    def days(self) -> tuple[int, int | None]:
        return self.band if self.kind == "retention" else (0, self.window)

    @property
    def last_day(self) -> int | None:
        """Offset of the last day that the outcome depends on."""
        a, b = self.days
        return a if self.kind == "retention" and b is None else None if b is None else b - 1


def filters(rows: DataFrame, conditions: list[tuple[str, str, list]]) -> DataFrame:
    """Rows that meet all (property, op, values)."""
    for prop, op, values in conditions:
        if op not in _OPS:
            raise EngineError("metric.unknown_filter", f"op {op!r}", op=op)
        rows = rows.filter(_OPS[op](F.col(prop), values))
    return rows


def metric_events(facts: DataFrame, event: str, value: str | None = None, conditions: list[tuple[str, str, list]] | None = None, missing: str = "error", scope: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, ts, value and the columns to ``keep``) of one fact; null values are refused among the rows in ``scope``, skipped, or taken as 0."""
    rows = filters(facts.filter(F.col("event") == event), conditions or [])
    if value is None:
        return rows.select("unit_id", "ts", F.lit(1.0).alias("value"), *keep)
    out = rows.select("unit_id", "ts", F.col(value).cast("double").alias("value"), *keep)
    if missing == "skip":
        return out.filter(F.col("value").isNotNull())
    if missing == "zero":
        return out.withColumn("value", F.coalesce("value", F.lit(0.0)))
    bad = out.filter(F.col("value").isNull() & (F.lit(True) if scope is None else scope)).count()
    if bad:
        raise EngineError("source.fact_null_values", f"{bad} null values of {event!r}", fact=event, column=value, rows=bad)
    return out


def _stats() -> list[Column]:
    return [F.count("*").alias("n_events"), F.sum("value").alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")]


def unit_day_stats(events: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """Per (unit, day): n_events, sum_value, min_value, max_value."""
    return events.filter(F.col("unit_id").isNotNull()).groupBy("unit_id", local_date(F.col("ts"), offset_minutes).alias("ds")).agg(*_stats())


def post_exposure_stats(events: DataFrame, exposures: DataFrame, offset_minutes: int = 0, anchor: str = "first_exposure_ts") -> DataFrame:
    """Unit-day statistics of events strictly after exposure, with day_offset (the exposure's day is 0)."""
    joined = events.join(exposures, "unit_id").filter(F.col("ts") > F.col(anchor))
    ds = local_date(F.col("ts"), offset_minutes)
    start = local_date(F.col(anchor), offset_minutes)
    return joined.groupBy("unit_id", "group_id", ds.alias("ds"), F.date_diff(ds, start).alias("day_offset")).agg(*_stats())


def pre_period_stats(events: DataFrame, exposures: DataFrame, days: int, offset_minutes: int = 0) -> DataFrame:
    """Per unit: x, the sum over events strictly before exposure from ``days`` days before its date on; 0 without events."""
    early = events.join(exposures.select("unit_id", "first_exposure_ts", "first_exposure_date"), "unit_id").filter(
        (F.col("ts") < F.col("first_exposure_ts")) & (local_date(F.col("ts"), offset_minutes) >= F.date_sub("first_exposure_date", days)))
    x = early.groupBy("unit_id").agg(F.sum("value").alias("x"))
    return exposures.select("unit_id").join(x, "unit_id", "left").select("unit_id", F.coalesce("x", F.lit(0.0)).alias("x"))


def censor(exposures: DataFrame, outcome: Outcome, edge: str | None) -> DataFrame:
    """Units whose outcome is final by the last observable day."""
    if edge is None or outcome.last_day is None:
        return exposures
    return exposures.filter(F.date_add("first_exposure_date", outcome.last_day) <= F.lit(edge).cast("date"))


def reduction(outcome: Outcome, n_days: Column | None = None) -> Column:
    """The unit's y over its unit-day statistics; null where it has no event."""
    n, total = F.sum("n_events"), F.sum("sum_value")
    if outcome.kind in ("conversion", "retention"):
        return (n > 0).cast("double")
    return {
        "sum": total, "count": n.cast("double"), "count_distinct": F.count_distinct("sum_value").cast("double"), "avg_event": total / n,
        "avg_calendar_day": total / (F.lit(1.0) if n_days is None else n_days), "min": F.min("min_value"), "max": F.max("max_value"),
    }[outcome.aggregation]


def zero_filled(outcome: Outcome) -> bool:
    return outcome.kind in ("conversion", "retention") or outcome.aggregation in _ZERO


def unit_totals(exposures: DataFrame, stats: DataFrame, outcome: Outcome, edge: str | None = None, name: str = "y") -> DataFrame:
    """Per eligible unit: its exposure's columns and y; without events 0, or null for avg_event, min and max.

    avg_calendar_day divides by the window's days, or without a window by the days from exposure to the edge.
    """
    a, b = outcome.days
    inside = stats.filter(F.col("day_offset") >= a) if a else stats
    inside = inside.filter(F.col("day_offset") < b) if b is not None else inside
    eligible = censor(exposures, outcome, edge)
    by_unit = inside.groupBy("unit_id").agg(reduction(outcome).alias("_y"))
    joined = eligible.join(by_unit, "unit_id", "left")
    y = F.col("_y")
    if outcome.kind == "mean" and outcome.aggregation == "avg_calendar_day":
        if b is None and edge is None:
            raise EngineError("metric.no_days", "avg_calendar_day needs a window or an edge")
        y = y / (F.lit(float(b)) if b is not None else F.date_diff(F.lit(edge).cast("date"), F.col("first_exposure_date")) + 1)
    y = F.coalesce(y, F.lit(0.0)) if zero_filled(outcome) else y
    return joined.withColumn(name, y).drop("_y")


def ratio_totals(exposures: DataFrame, numerator: DataFrame, denominator: DataFrame, num: Outcome, den: Outcome, edge: str | None = None) -> DataFrame:
    """y and den of each eligible unit; the numerator's window decides eligibility."""
    top = unit_totals(exposures, numerator, num, edge)
    bottom = unit_totals(exposures, denominator, den, None, "den").select("unit_id", "den")
    return top.join(bottom, "unit_id", "left").withColumn("den", F.coalesce("den", F.lit(0.0)))


def panel(exposures: DataFrame, stats: DataFrame, edge: str, days: int | None = None) -> DataFrame:
    """The dense unit-by-day panel from exposure to the edge (or ``days`` days), zero-filled; a unit exposed after the edge
    keeps one row without a day."""
    last = F.least(F.date_add("first_exposure_date", days - 1), F.lit(edge).cast("date")) if days else F.lit(edge).cast("date")
    n = F.date_diff(last, F.col("first_exposure_date")) + 1
    offsets = F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    spine = exposures.select("unit_id", "group_id", "first_exposure_date", offsets.alias("day_offset"))
    spine = spine.withColumn("ds", F.expr("date_add(first_exposure_date, day_offset)"))
    return spine.join(stats.drop("group_id", "day_offset"), ["unit_id", "ds"], "left").select(
        "unit_id", "group_id", "ds", "day_offset", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("sum_value", F.lit(0.0)).alias("sum_value"), "min_value", "max_value")


def winsorize(totals: DataFrame, lower: float | None = None, upper: float | None = None, *, bounds: tuple[float | None, float | None] | None = None, column: str = "y") -> DataFrame:
    """Clip at pooled linear-interpolated percentiles over all arms, or at fixed bounds; adds the bounds and who was clipped."""
    c = F.col(column)
    if bounds is not None:
        low, high = (F.lit(x).cast("double") for x in bounds)
        joined = totals.withColumns({"winsor_lower_bound": low, "winsor_upper_bound": high})
    else:
        cuts = totals.agg(*(F.percentile(c, p).alias(f"winsor_{side}_bound") if p is not None else F.lit(None).cast("double").alias(f"winsor_{side}_bound") for side, p in (("lower", lower), ("upper", upper))))
        joined = totals.crossJoin(F.broadcast(cuts))  # one row
    low, high = F.col("winsor_lower_bound"), F.col("winsor_upper_bound")
    return joined.withColumns({"winsor_low": F.coalesce(c < low, F.lit(False)), "winsor_high": F.coalesce(c > high, F.lit(False))}).withColumn(
        column, F.when(c.isNull(), c).otherwise(F.greatest(F.least(c, F.coalesce(high, c)), F.coalesce(low, F.least(c, F.coalesce(high, c))))))


def daily_moments(exposures: DataFrame, stats: DataFrame, edge: str, aggregation: str = "sum") -> DataFrame:
    """Per calendar day and arm: moments of the day's y, without a spine: over all units exposed by then, zeros counted; for
    avg_event, min and max over the units with an event that day.  ``aggregation`` may be conversion."""
    n, total = F.col("n_events").cast("double"), F.col("sum_value").cast("double")
    y = {"sum": total, "count": n, "conversion": F.lit(1.0), "avg_calendar_day": total, "avg_event": total / n, "min": F.col("min_value").cast("double"), "max": F.col("max_value").cast("double")}.get(aggregation)
    if y is None:
        raise EngineError("metric.day_aggregation", f"{aggregation!r} has no value for a day", aggregation=aggregation)
    active = stats.filter(F.col("ds") <= F.lit(edge).cast("date")).groupBy("ds", "group_id").agg(F.count(y).alias("k"), F.avg(y).alias("m"), (F.count(y) * F.var_pop(y)).alias("s"))
    if aggregation in _ZERO:
        return _with_zeros(exposures, active, edge)
    return active.filter("k > 0").select("ds", "group_id", F.col("k").alias("n"), F.col("m").alias("ref_y"), F.lit(0.0).alias("cy1"), F.col("s").alias("cy2"))


def asof_moments(exposures: DataFrame, stats: DataFrame, edge: str, aggregation: str = "sum") -> DataFrame:
    """Per calendar day and arm: moments of y cumulated from exposure to that day, over all units exposed by then.

    Only active days carry a change of a unit's total, so the sums of y and of y squared of the units that have been active
    change by differences on those days; running sums over days and arms give every day's moments, and the units that haven't
    are zeros that are counted: no unit-by-day spine.  Totals are taken as differences from the mean of the arm's final ones,
    so a large mean doesn't cancel; a day whose totals are a small part of the final ones keeps their absolute precision.
    """
    value = {"sum": F.col("sum_value").cast("double"), "count": F.col("n_events").cast("double"), "conversion": F.lit(1.0)}.get(aggregation)
    if value is None:
        raise EngineError("metric.day_aggregation", f"{aggregation!r} doesn't cumulate over days", aggregation=aggregation)
    scoped = stats.filter(F.col("ds") <= F.lit(edge).cast("date")).withColumn("v", F.coalesce(value, F.lit(0.0)))
    order = Window.partitionBy("unit_id").orderBy("ds")
    upto = F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0))
    if aggregation == "conversion":
        upto = F.least(upto, F.lit(1.0))
    centre = scoped.groupBy("group_id", "unit_id").agg(F.sum("v").alias("v")).groupBy("group_id").agg(F.avg("v").alias("centre"))  # a row per arm
    run = scoped.withColumn("now", upto).withColumn("was", F.lag("now").over(order)).join(F.broadcast(centre), "group_id")
    now, was = F.col("now") - F.col("centre"), F.col("was") - F.col("centre")
    step, first = F.col("now") - F.col("was"), F.col("was").isNull()
    change = run.groupBy("ds", "group_id").agg(
        F.count_if(first).alias("dk"), F.sum(F.when(first, now).otherwise(step)).alias("dy"), F.sum(F.when(first, now * now).otherwise(step * (now + was))).alias("dy2"), F.first("centre").alias("centre"))
    line = Window.partitionBy("group_id").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    active = exposure_grid(exposures, edge).join(change, ["ds", "group_id"], "left").select(
        "ds", "group_id", F.sum(F.coalesce("dk", F.lit(0))).over(line).alias("k"), F.sum(F.coalesce("dy", F.lit(0.0))).over(line).alias("s1"), F.sum(F.coalesce("dy2", F.lit(0.0))).over(line).alias("s2"),
        F.last("centre", ignorenulls=True).over(line).alias("centre"))
    mean = F.col("s1") / F.col("k")
    return _with_zeros(exposures, active.filter("k > 0").select("ds", "group_id", "k", (F.col("centre") + mean).alias("m"), F.greatest(F.col("s2") - F.col("k") * mean * mean, F.lit(0.0)).alias("s")), edge)


def exposure_grid(exposures: DataFrame, edge: str) -> DataFrame:
    """Per day from the first exposure to the edge and arm: n, the units exposed by then."""
    by_day = exposures.groupBy(F.col("first_exposure_date").alias("ds"), "group_id").agg(F.count("*").alias("new"))
    arms = by_day.groupBy("group_id").agg(F.min("ds").alias("a"))
    first = by_day.agg(F.min("ds").alias("first"))
    days = arms.crossJoin(F.broadcast(first)).select("group_id", F.explode(F.sequence("first", F.lit(edge).cast("date"))).alias("ds"))
    line = Window.partitionBy("group_id").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(by_day, ["ds", "group_id"], "left").select("ds", "group_id", F.sum(F.coalesce("new", F.lit(0))).over(line).alias("n"))


def _with_zeros(exposures: DataFrame, active: DataFrame, edge: str) -> DataFrame:
    """Moments over n units of which k have mean m and square sum s, and the rest are 0."""
    joined = exposure_grid(exposures, edge).filter("n > 0").join(active, ["ds", "group_id"], "left")
    k, m = F.coalesce("k", F.lit(0)), F.coalesce("m", F.lit(0.0))
    mean = k * m / F.col("n")
    return joined.select("ds", "group_id", "n", mean.alias("ref_y"), F.lit(0.0).alias("cy1"), (F.coalesce("s", F.lit(0.0)) + k * (m - mean) * (m - mean) + (F.col("n") - k) * mean * mean).alias("cy2"))


def cohort_retention(exposures: DataFrame, stats: DataFrame, outcome: Outcome, edge: str | None = None) -> DataFrame:
    """Per exposure date and arm: moments of retention."""
    from .moments import group_summary

    return group_summary(unit_totals(exposures, stats, outcome, edge), ["first_exposure_date", "group_id"], binary=True)


def eligibility(exposures: DataFrame, stats: DataFrame, outcome: Outcome, edge: str) -> DataFrame:
    """Per arm: assigned, mature, not mature, and mature without any event in the window."""
    a, b = outcome.days
    inside = stats.filter((F.col("day_offset") >= a) & (F.lit(True) if b is None else F.col("day_offset") < b)).select("unit_id").distinct().withColumn("seen", F.lit(1))
    ready = F.lit(True) if outcome.last_day is None else F.date_add("first_exposure_date", outcome.last_day) <= F.lit(edge).cast("date")
    joined = exposures.join(inside, "unit_id", "left").withColumn("mature", ready)
    return joined.groupBy("group_id").agg(F.count("*").alias("assigned"), F.count_if("mature").alias("eligible"), F.count_if(~F.col("mature")).alias("not_mature"), F.count_if(F.col("mature") & F.col("seen").isNull()).alias("no_observed"))
