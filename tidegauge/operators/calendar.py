"""Calendar reports without an experiment: periods, populations, unit values, totals, actives, ratios, rolling windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.scalar import dimension, local_date, period_end, period_start

MOST_DAYS = 3653
ZERO_FILLED = ("sum", "count", "count_distinct", "conversion", "avg_calendar_day")


def horizon(facts: list[tuple[DataFrame, str]], offset_minutes: int = 0) -> DataFrame:
    """One row: end_edge, the least of the facts' last local days; a fact without rows has no last day."""
    one = None
    for i, (rows, event) in enumerate(facts):
        h = rows.filter(F.col("event") == event).agg(F.coalesce(local_date(F.max("ts"), offset_minutes), F.lit("9999-12-31").cast("date")).alias(f"h{i}"))
        one = h if one is None else one.crossJoin(F.broadcast(h))
    cols = [F.col(f"h{i}") for i in range(len(facts))]
    return one.select((cols[0] if len(cols) == 1 else F.least(*cols)).alias("end_edge"))


def periods(spark: SparkSession, start: str, end: str, grain: str, week_start: str = "monday", data_horizon: str | None = None) -> DataFrame:
    """period, period_end, period_complete, n_days: the periods that cover [start, end]; n_days counts the requested ones."""
    span = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    if span > MOST_DAYS:
        raise EngineError("calendar.range", f"{span} days", span=span, most=MOST_DAYS)
    days = spark.range(max(0, span)).select(F.expr(f"date_add(date'{start}', cast(id as int))").alias("ds"))
    spine = days.groupBy(period_start(F.col("ds"), grain, week_start).alias("period")).agg(F.count("*").alias("n_days"))
    last = period_end(F.col("period"), grain)
    edge = F.least(F.lit(end), F.lit(data_horizon or end)).cast("date")
    return spine.select("period", last.alias("period_end"), ((F.col("period") >= F.lit(start).cast("date")) & (last <= edge)).alias("period_complete"), "n_days")


def _scoped(rows: DataFrame, start: str, end: str, grain: str, week_start: str, offset_minutes: int = 0) -> DataFrame:
    ds = F.col("ds") if "ds" in rows.columns else local_date(F.col("ts"), offset_minutes)
    out = rows.withColumn("ds", ds).filter((F.col("ds") >= F.lit(start).cast("date")) & (F.col("ds") <= F.lit(end).cast("date")))
    return out.withColumn("period", period_start(F.col("ds"), grain, week_start))


def unit_values(stats: DataFrame, spine: DataFrame, aggregation: str, start: str, end: str, grain: str, week_start: str = "monday") -> DataFrame:
    """(unit_id, period, y) from unit-day statistics; units without events have no row."""
    n, total = F.sum("n_events"), F.sum("sum_value")
    how = {
        "conversion": (n > 0).cast("double"), "sum": total, "count": n.cast("double"), "avg_event": total / n, "avg_calendar_day": total,
        "min": F.min("min_value"), "max": F.max("max_value"), "count_distinct": F.count_distinct("sum_value").cast("double"),
    }
    if aggregation not in how:
        raise EngineError("metric.unknown_aggregation", f"{aggregation!r}", aggregation=aggregation)
    out = _scoped(stats, start, end, grain, week_start).groupBy("unit_id", "period").agg(how[aggregation].alias("y"))
    if aggregation == "avg_calendar_day":
        out = out.join(F.broadcast(spine.select("period", "n_days")), "period").select("unit_id", "period", (F.col("y") / F.col("n_days")).alias("y"))
    return out


def population(facts: DataFrame, spine: DataFrame, start: str, end: str, grain: str, week_start: str = "monday", given: DataFrame | None = None, offset_minutes: int = 0) -> DataFrame:
    """(unit_id, period): units active in any fact, or ``given`` (unit_id: in every period; with ds: in the days' periods)."""
    if given is None:
        given = facts.filter(F.col("unit_id").isNotNull()).select("unit_id", local_date(F.col("ts"), offset_minutes).alias("ds"))
    elif "unit_id" not in given.columns:
        raise EngineError("calendar.population", "no unit_id", columns=given.columns)
    given = given.filter(F.col("unit_id").isNotNull())
    if "ds" in given.columns:
        return _scoped(given, start, end, grain, week_start).select("unit_id", "period").distinct()
    return given.select("unit_id").distinct().crossJoin(F.broadcast(spine.select("period")))  # at most 3,653 periods


def period_moments(values: DataFrame, members: DataFrame, spine: DataFrame, *, zero_fill: bool, by: DataFrame | None = None) -> DataFrame:
    """Per period (and a dimension): n, ref_y, cy1, cy2 over the population; an empty period keeps a row with n = 0."""
    if zero_fill:
        rows = members.join(values, ["unit_id", "period"], "left").select("unit_id", "period", F.coalesce("y", F.lit(0.0)).alias("y"))
    else:
        rows = values.join(members, ["unit_id", "period"], "left_semi").select("unit_id", "period", "y")
    keys = ["period"]
    if by is not None:
        (dim,) = [c for c in by.columns if c not in ("unit_id", "period")]
        rows = rows.join(by, ["unit_id", "period"], "left").withColumn(dim, dimension(F.col(dim)))
        keys.append(dim)
    agg = rows.groupBy(*keys).agg(F.count("y").alias("n"), F.avg("y").alias("ref_y"), F.sum(F.lit(0.0)).alias("cy1"), (F.count("y") * F.var_pop("y")).alias("cy2"))
    out = spine.select("period", "period_complete").join(agg, "period", "left")
    return out.select("period", "period_complete", *keys[1:], F.coalesce("n", F.lit(0)).alias("n"), "ref_y", "cy1", "cy2")


def interval(moments: DataFrame, z: float, conversion: bool = False) -> DataFrame:
    """value, ci_lb and ci_ub: Wilson for a conversion, mean and normal standard error otherwise."""
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    mean = F.col("ref_y") + F.col("cy1") / n
    if conversion:
        scale = 1 + z * z / n
        centre = (mean + z * z / (2 * n)) / scale
        half = z * F.sqrt(mean * (1 - mean) / n + z * z / (4 * n * n)) / scale
    else:
        centre = mean
        half = z * F.sqrt(F.greatest(F.col("cy2") - F.col("cy1") * F.col("cy1") / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0)) / n)
    return moments.withColumns({"value": mean, "ci_lb": centre - half, "ci_ub": centre + half})


def ratio_values(top: DataFrame, bottom: DataFrame, members: DataFrame, spine: DataFrame) -> DataFrame:
    """Per period: n and the ratio of sums over the population; null for a zero denominator."""
    both = members.join(top.withColumnRenamed("y", "a"), ["unit_id", "period"], "left").join(bottom.withColumnRenamed("y", "b"), ["unit_id", "period"], "left")
    agg = both.groupBy("period").agg(F.count("*").alias("n"), (F.sum(F.coalesce("a", F.lit(0.0))) / F.nullif(F.sum(F.coalesce("b", F.lit(0.0))), F.lit(0.0))).alias("value"))
    return spine.select("period", "period_complete").join(agg, "period", "left").select("period", "period_complete", F.coalesce("n", F.lit(0)).alias("n"), "value")


def _bare(aggregation: str) -> Column:
    how = {"sum": F.sum("value"), "count": F.count("*").cast("double"), "count_distinct": F.count_distinct("value").cast("double"), "avg_event": F.avg("value"), "avg_calendar_day": F.sum("value"), "min": F.min("value"), "max": F.max("value")}
    if aggregation not in how:
        raise EngineError("metric.unknown_aggregation", f"{aggregation!r}", aggregation=aggregation)
    return how[aggregation]


def total_values(events: DataFrame, spine: DataFrame, aggregation: str, start: str, end: str, grain: str, week_start: str = "monday", by: tuple[str, ...] = (), offset_minutes: int = 0) -> DataFrame:
    """Per period an aggregate of event values without a unit layer; dense without ``by``, sparse with it."""
    agg = _scoped(events, start, end, grain, week_start, offset_minutes).groupBy("period", *by).agg(_bare(aggregation).alias("value"))
    cols = spine.select("period", "period_complete", "n_days")
    out = agg.join(cols, "period") if by else cols.join(agg, "period", "left")
    value = F.col("value") / F.col("n_days") if aggregation == "avg_calendar_day" else F.col("value")
    if not by and aggregation in ZERO_FILLED:
        value = F.coalesce(value, F.lit(0.0))
    return out.select("period", "period_complete", *by, value.alias("value"))


def active_values(events: DataFrame, spine: DataFrame, start: str, end: str, grain: str, week_start: str = "monday", by: tuple[str, ...] = (), offset_minutes: int = 0, approximate: bool = False) -> DataFrame:
    """Per period the distinct units with an event; exact, unless ``approximate`` asks for a sketch."""
    count = F.approx_count_distinct("unit_id", 0.01) if approximate else F.count_distinct("unit_id")
    agg = _scoped(events, start, end, grain, week_start, offset_minutes).groupBy("period", *by).agg(count.alias("value"))
    cols = spine.select("period", "period_complete")
    if by:
        return agg.join(cols, "period").select("period", "period_complete", *by, "value")
    return cols.join(agg, "period", "left").select("period", "period_complete", F.coalesce("value", F.lit(0)).alias("value"))


def _fed(rows: DataFrame, grain: str, window: int, week_start: str) -> DataFrame:
    """Each day's rows, once for every period whose trailing ``window`` days hold the day: an explode in place of a range join."""
    last = period_end(period_start(F.col("ds"), grain, week_start), grain)
    ends = F.sequence(last, F.date_add("ds", window - 1))  # days that may end a period
    ends = F.when(last <= F.date_add("ds", window - 1), ends).otherwise(F.array().cast("array<date>"))
    out = rows.select("*", F.explode(ends).alias("period_end"))
    own = period_start(F.col("period_end"), grain, week_start)
    return out.filter(period_end(own, grain) == F.col("period_end"))


def rolling_active_values(events: DataFrame, spine: DataFrame, window: int, start: str, end: str, grain: str = "day", week_start: str = "monday", by: tuple[str, ...] = (), offset_minutes: int = 0) -> DataFrame:
    """Per period the distinct units with an event in the ``window`` days that end with it; days collapse per unit first."""
    days = _rolling_days(events, window, start, end, offset_minutes).select("unit_id", "ds", *by).distinct()
    agg = _fed(days, grain, window, week_start).groupBy("period_end", *by).agg(F.count_distinct("unit_id").alias("value"))
    return _rolled(agg, spine, by, F.lit(0))


def rolling_total_values(events: DataFrame, spine: DataFrame, aggregation: str, window: int, start: str, end: str, grain: str = "day", week_start: str = "monday", by: tuple[str, ...] = (), offset_minutes: int = 0) -> DataFrame:
    """Per period an aggregate over the ``window`` days that end with it, from a row per day (and value, for distinct ones)."""
    scoped = _rolling_days(events, window, start, end, offset_minutes)
    if aggregation == "count_distinct":
        fed = _fed(scoped.select("value", "ds", *by).distinct(), grain, window, week_start)
        agg = fed.groupBy("period_end", *by).agg(F.count_distinct("value").cast("double").alias("value"))
    else:
        days = scoped.groupBy("ds", *by).agg(F.count("*").alias("n"), F.count("value").alias("k"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        how = {"sum": F.sum("s"), "count": F.sum("n").cast("double"), "avg_event": F.sum("s") / F.sum("k"), "avg_calendar_day": F.sum("s") / window, "min": F.min("lo"), "max": F.max("hi")}
        if aggregation not in how:
            raise EngineError("metric.unknown_aggregation", f"{aggregation!r}", aggregation=aggregation)
        agg = _fed(days, grain, window, week_start).groupBy("period_end", *by).agg(how[aggregation].alias("value"))
    return _rolled(agg, spine, by, F.lit(0.0) if aggregation in ZERO_FILLED else None)


def _rolling_days(events: DataFrame, window: int, start: str, end: str, offset_minutes: int) -> DataFrame:
    ds = local_date(F.col("ts"), offset_minutes)
    return events.withColumn("ds", ds).filter((ds >= F.date_sub(F.lit(start).cast("date"), window - 1)) & (ds <= F.lit(end).cast("date")))


def _rolled(agg: DataFrame, spine: DataFrame, by: tuple[str, ...], empty: Column | None) -> DataFrame:
    cols = spine.select("period", "period_end", "period_complete")
    if by:
        return agg.join(cols, "period_end").select("period", "period_complete", *by, "value")
    value = F.col("value") if empty is None else F.coalesce("value", empty)
    return cols.join(agg, "period_end", "left").select("period", "period_complete", value.alias("value"))


def asof_property(observations: DataFrame, spine: DataFrame, dim: str, offset_minutes: int = 0) -> DataFrame:
    """(unit_id, period, dim): the latest value by the period's end, of equal times the largest; no look-ahead.

    Observations collapse to a row per unit and day, each day's value holds until the unit's next one, and the periods whose
    ends lie in that range take it: an equality of dates after an explode of at most the report's periods.
    """
    from pyspark.sql import Window

    ds = local_date(F.col("ts"), offset_minutes)
    daily = observations.groupBy("unit_id", ds.alias("ds")).agg(F.max(F.struct("ts", dim)).alias("last")).select("unit_id", "ds", F.col(f"last.{dim}").alias(dim))
    until = F.lead("ds").over(Window.partitionBy("unit_id").orderBy("ds"))
    ranges = daily.withColumn("until", until)
    ends = spine.agg(F.array_sort(F.collect_list("period_end")).alias("ends"))  # at most 3,653 dates in one row
    held = ranges.crossJoin(F.broadcast(ends)).select("unit_id", dim, F.explode(F.filter("ends", lambda e: (e >= F.col("ds")) & (F.col("until").isNull() | (e < F.col("until"))))).alias("period_end"))
    return held.join(F.broadcast(spine.select("period", "period_end")), "period_end").select("unit_id", "period", dim)
