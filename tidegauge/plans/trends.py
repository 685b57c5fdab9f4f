"""Calendar trends of declared metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.distributions import norm_ppf
from ..operators import calendar as C
from ..operators import dims
from ..operators import outcomes as O
from .definitions import Definitions, Metric


class MetricTrends:
    """metric(name, grain, start, end, …): one row per period (and dimension)."""

    def __init__(self, spark: SparkSession, definitions: Definitions, unit: str, offset_minutes: int = 0):
        self.spark, self.defs, self.unit, self.offset = spark, definitions, unit, offset_minutes

    def _facts(self, fact: str) -> DataFrame:
        """The fact's source with its properties under their names and its dimensions joined."""
        s = self.defs.source_of(fact)
        out = self.spark.sql(s.sql).withColumns({"unit_id": F.col(self.unit).cast("string"), "ts": F.col(s.timestamp_column).cast("timestamp")})
        for p in s.properties:
            out = out if p.column == p.name else out.withColumn(p.name, F.col(p.column))
        for name in s.dims:
            d = self.defs.dim_sources[name]
            frame = self.spark.sql(d.sql)
            dims.check(frame, d.entity, d.kind)
            out = {"plain": dims.join_plain, "ranges": dims.join_ranges, "changelog": dims.join_changelog}[d.kind](out, frame, d.entity)
        return out

    @staticmethod
    def _filters(m: Metric) -> list[tuple]:
        return [(c["property"], c["op"], c["values"]) for c in m.filters]

    def _events(self, m: Metric, fact: str, value: bool, by: str | None = None) -> DataFrame:
        f = self.defs.fact(fact)
        return O.metric_events(self._facts(fact), fact, f.column if value else None, self._filters(m), f.missing, **({"keep": (by,)} if by else {}))

    def metric(self, name: str, grain: str, start: str, end: str | None = None, *, by: str | None = None, population: DataFrame | None = None, window: int | None = None, week_start: str = "monday", alpha: float = 0.05) -> DataFrame:
        m = self.defs.metrics[name]
        if m.type in ("retention", "quantile"):
            raise EngineError("trends.unsupported", f"{m.type} metrics have no calendar trend", metric=name)
        facts = [m.fact] if m.type != "ratio" else [m.numerator.fact, m.denominator.fact]
        last = str(C.horizon([(self._facts(f), f) for f in facts], self.offset).first()[0])
        end = end or last
        spine = C.periods(self.spark, start, end, grain, week_start, last)
        args = (start, end, grain, week_start)
        if m.type == "active":
            e = O.filters(self._facts(m.fact).filter(F.col("event") == m.fact), self._filters(m))
            if window:
                return C.rolling_active_values(e, spine, window, *args, by=(by,) if by else (), offset_minutes=self.offset)
            return C.active_values(e, spine, *args, by=(by,) if by else (), offset_minutes=self.offset)
        if m.type == "total":
            e = self._events(m, m.fact, m.aggregation != "count", by)
            if window and by:
                raise EngineError("trends.rolling_by", "rolling totals have no dimension", metric=name)
            if window:
                return C.rolling_total_values(e, spine, m.aggregation, window, *args, offset_minutes=self.offset)
            return C.total_values(e, spine, m.aggregation, *args, by=(by,) if by else (), offset_minutes=self.offset)
        if window:
            raise EngineError("trends.window", "rolling windows are for totals and actives", metric=name)
        members = C.population(self._facts(facts[0]), spine, *args, given=population, offset_minutes=self.offset)

        def values(fact: str, aggregation: str) -> DataFrame:
            stats = O.unit_day_stats(self._events(m, fact, aggregation not in ("count", "conversion")), self.offset)
            return C.unit_values(stats, spine, aggregation, *args)

        if m.type == "ratio":
            return C.ratio_values(values(m.numerator.fact, m.numerator.aggregation), values(m.denominator.fact, m.denominator.aggregation), members, spine)
        aggregation = "conversion" if m.type == "conversion" else m.aggregation
        dim = C.asof_property(self._facts(m.fact), spine, by, self.offset) if by else None
        moments = C.period_moments(values(m.fact, aggregation), members, spine, zero_fill=aggregation in C.ZERO_FILLED, by=dim)
        return C.interval(moments, norm_ppf(1 - alpha / 2), m.type == "conversion").withColumn("metric", F.lit(name))
