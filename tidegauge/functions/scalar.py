"""Calendar, null and number expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

MISSING = "<missing>"


def local_date(ts: Column, offset_minutes: int = 0) -> Column:
    """The date of a UTC timestamp at a fixed offset (the day boundary)."""
    return F.to_date(ts if not offset_minutes else ts + F.expr(f"make_dt_interval(0, 0, {offset_minutes}, 0)"))


def period_start(ds: Column, grain: str, week_start: str = "monday") -> Column:
    if grain == "day":
        return ds
    if grain == "week":
        return F.trunc(ds, "week").cast("date") if week_start == "monday" else F.date_sub(F.trunc(F.date_add(ds, 1), "week"), 1)
    if grain == "month":
        return F.trunc(ds, "month")
    raise EngineError("calendar.unknown_grain", f"grain {grain!r}", grain=grain)


def period_end(period: Column, grain: str) -> Column:
    """Inclusive last day of the period that starts at ``period``."""
    return {"day": period, "week": F.date_add(period, 6), "month": F.last_day(period)}[grain]


def dimension(c: Column) -> Column:
    """A property's value as a segment label."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def not_finite(c: Column) -> tuple[Column, Column]:
    """(is NaN, is infinite)."""
    return F.isnan(c), F.abs(c) == float("inf")


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def stable_log_ratio(treated: Column, control: Column) -> Column:
    """log(treated / control), by log1p of the relative difference where they are within a factor of two."""
    close = (treated < 2 * control) & (control < 2 * treated)
    return F.when(close, F.log1p(F.try_divide(treated - control, control))).otherwise(F.log(treated) - F.log(control))
