"""Experiments from data frames: one row per unit, one row per unit and day, moment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import effects
from ..operators import cleaning
from ..operators import moments as M


def _numeric(df: DataFrame, metric: str, kind: str | None) -> tuple[DataFrame, str]:
    t = dict(df.dtypes)[metric]
    if t == "boolean":
        return df.withColumn(metric, F.col(metric).cast("double")), kind or "conversion"
    if kind is None and t in ("tinyint", "smallint", "int", "bigint"):
        raise EngineError("frame.integer_metric", f"{metric!r} needs a type (mean or conversion)", metric=metric)
    out = df.withColumn("_y", F.expr(f"try_cast(`{metric}` as double)"))
    bad = out.filter(F.col("_y").isNull() & F.col(metric).isNotNull()).limit(1).count() if t == "string" else 0
    if bad:
        raise EngineError("frame.not_numeric", f"{metric!r}", metric=metric)
    return out.withColumn(metric, F.col("_y")).drop("_y"), kind or "mean"


class FrameExperiment:
    """Unit rows with an arm and metrics; the same readouts as a warehouse experiment."""

    def __init__(self, units: DataFrame, group: str, control: str, kinds: dict[str, str]):
        self.units, self.group, self.control, self.kinds = units, group, control, kinds

    def totals(self, metric: str, den: str | None = None, covariate: str | None = None) -> DataFrame:
        more = [F.col(c).cast("double").alias(a) for c, a in ((den, "den"), (covariate, "x")) if c]
        return self.units.select(F.col(self.group).cast("string").alias("group_id"), F.col(metric).alias("y"), *more)

    def moments(self, metric: str, **columns: str) -> DataFrame:
        return M.group_summary(self.totals(metric, **columns), binary=self.kinds.get(metric) == "conversion")

    def run(self, alpha: float = 0.05) -> DataFrame:
        out = None
        for m in self.kinds:
            r = effects.relative_lift(self.moments(m), self.control, alpha)
            r = r.select(F.lit(m).alias("metric"), *r.columns)
            out = r if out is None else out.unionByName(r)
        return out

    def quantile(self, metric: str, q: float) -> DataFrame:
        from ..operators.designs import quantile_lift

        return quantile_lift(self.totals(metric), q, self.control)


def from_unit_summary(df: DataFrame, unit: str, group: str, metrics: dict[str, str | None] | list[str], control: str, missing: str = "error") -> FrameExperiment:
    """One row per unit; metric kinds are inferred from booleans, integers need one."""
    kinds = metrics if isinstance(metrics, dict) else dict.fromkeys(metrics)
    absent = [c for c in (unit, group, *kinds) if c not in df.columns]
    if absent:
        raise EngineError("frame.missing_columns", f"{absent}", columns=absent)
    if df.groupBy(unit).count().filter("count > 1").limit(1).count():
        raise EngineError("frame.duplicate_units", f"{unit!r} isn't unique")
    found = {}
    for m, kind in kinds.items():
        df, found[m] = _numeric(df, m, kind)
        df = cleaning.apply_missing(df, m, missing)
    return FrameExperiment(df, group, control, found)


def from_unit_panel(df: DataFrame, unit: str, group: str, day: str, exposure_day: str, metrics: list[str], control: str, window: int | None = None, edge: str | None = None) -> FrameExperiment:
    """One row per unit and day, sparse is fine: days from exposure on, within the window, summed; absent days are zero."""
    offset = F.date_diff(F.col(day).cast("date"), F.col(exposure_day).cast("date"))
    units = df.select(unit, group, exposure_day).distinct()
    if units.groupBy(unit).count().filter("count > 1").limit(1).count():
        raise EngineError("frame.panel_units", "a unit has several arms or exposure days")
    if edge and window:
        units = units.filter(F.date_add(F.col(exposure_day).cast("date"), window - 1) <= F.lit(edge).cast("date"))
    inside = df.filter((offset >= 0) & (offset < window if window else F.lit(True)))
    sums = inside.groupBy(unit).agg(*(F.sum(F.col(m).cast("double")).alias(m) for m in metrics))
    joined = units.join(sums, unit, "left")
    return FrameExperiment(cleaning.zeros(joined, metrics), group, control, dict.fromkeys(metrics, "mean"))


def from_moments(moments: DataFrame, control: str, alpha: float = 0.05) -> DataFrame:
    """Readout of exported moment rows (metric, group_id, n, ref_y, cy2, …)."""
    return effects.relative_lift(moments, control, alpha, ["metric"] if "metric" in moments.columns else None)
