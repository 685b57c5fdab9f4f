"""An experiment bound to a session: sources resolved once, metrics compiled to moments, readouts as rows.

Metrics that share a resolved measure (fact, filters, value column) share its unit-day statistics, which are persisted
once per reader.  The driver sees a row per arm, metric, segment or day, never units.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import diagnostics, effects
from ..operators import designs, dims, segments, winsor
from ..operators import exposures as X
from ..operators import moments as M
from ..operators import outcomes as O
from .definitions import Definitions, Experiment, FactSource, Metric, load_definitions


class Reader:
    """Readouts of one experiment."""

    def __init__(self, spark: SparkSession, definitions: Definitions, experiment: Experiment):
        self.spark, self.defs, self.exp = spark, definitions, experiment
        self._facts: dict[str, DataFrame] = {}
        self._stats: dict[tuple, DataFrame] = {}
        self._exposures: DataFrame | None = None

    # -- sources

    def facts(self, source: FactSource) -> DataFrame:
        """Canonical rows of a fact source: unit_id, ts, event, value columns, properties, dimension columns."""
        if source.name not in self._facts:
            raw = self.spark.sql(source.sql)
            columns = [self.exp.unit, source.timestamp_column, *({"event"} if source.facts else set()), *(f.column for f in source.facts if f.column), *(p.column for p in source.properties)]
            missing = [c for c in dict.fromkeys(columns) if c not in raw.columns]
            if missing:
                raise EngineError("definition.fact_source.missing_columns", f"{source.name}: {missing}", columns=missing)
            rename = {p.column: p.name for p in source.properties}
            out = raw.withColumns({"unit_id": F.col(self.exp.unit).cast("string"), "ts": F.col(source.timestamp_column).cast("timestamp")})
            for old, new in rename.items():
                out = out if old == new else out.withColumn(new, F.col(old))
            if "experiment_id" not in out.columns:
                out = out.withColumn("experiment_id", F.lit(None).cast("string"))
            for name in source.dims:
                d = self.defs.dim_sources[name]
                frame = self.spark.sql(d.sql)
                dims.check(frame, d.entity, d.kind)
                out = {"plain": dims.join_plain, "ranges": dims.join_ranges, "changelog": dims.join_changelog}[d.kind](out, frame, d.entity)
            self._facts[source.name] = out
        return self._facts[source.name]

    def exposures(self) -> DataFrame:
        if self._exposures is None:
            e = self.defs.exposures[self.exp.exposure]
            if e.sql:
                rows = self.spark.sql(e.sql)
            else:
                rows = self.facts(self.defs.source_of(e.fact)).filter(F.col("event") == e.fact)
                rows = O.filters(rows, [(f["property"], f["op"], f["values"]) for f in e.filters])
            carry = (self.exp.cluster,) if self.exp.cluster else ()
            self._exposures = X.first_exposures(rows, self.exp.name, self.exp.start, self.exp.end, mixed=self.exp.mixed, carry=carry).persist()
        return self._exposures

    def edge(self, fact: str) -> str:
        as_of = self.defs.source_of(fact).data_as_of
        return min(self.exp.end, as_of) if as_of else self.exp.end

    def stats(self, fact: str, conditions: tuple = (), value: bool = True) -> DataFrame:
        key = (fact, conditions, value)
        if key not in self._stats:
            f = self.defs.fact(fact)
            rows = self.facts(self.defs.source_of(fact))
            rows = rows.join(self.exposures().select("unit_id"), "unit_id", "left_semi")
            events = O.metric_events(rows, fact, f.column if value else None, [tuple(c) for c in conditions], f.missing)
            self._stats[key] = O.post_exposure_stats(events, self.exposures()).persist()
        return self._stats[key]

    # -- metrics

    def _metric(self, name: str) -> Metric:
        if name not in self.defs.metrics:
            raise EngineError("readout.unknown_metric", f"{name!r}", metric=name)
        return self.defs.metrics[name]

    def totals(self, name: str, clip: bool = True) -> DataFrame:
        """unit_id, group_id, y (and den, x): one row per eligible unit."""
        m = self._metric(name)
        conditions = tuple((f["property"], f["op"], tuple(f["values"])) for f in m.filters)
        if m.type == "ratio":
            n, d = m.numerator, m.denominator
            out = O.ratio_totals(self.exposures(), self.stats(n.fact, conditions, n.aggregation != "count"), self.stats(d.fact, conditions, d.aggregation != "count"), m.outcome, O.Outcome("mean", d.aggregation, d.window_days), self.edge(n.fact))
        else:
            value = m.type in ("mean", "quantile") and m.aggregation != "count"
            out = O.unit_totals(self.exposures(), self.stats(m.fact, conditions, value), m.outcome, self.edge(m.fact))
        if m.n_pre_periods:
            f = self.defs.fact(m.fact)
            events = O.metric_events(self.facts(self.defs.source_of(m.fact)), m.fact, f.column, [tuple(c) for c in conditions], "skip")
            out = out.join(O.pre_period_stats(events, self.exposures(), m.n_pre_periods), "unit_id", "left")
        if m.winsorize and clip:
            w = m.winsorize
            bounds = (w.get("lower_bound"), w.get("upper_bound")) if "lower_bound" in w or "upper_bound" in w else None
            out = O.winsorize(out, w.get("lower_percentile"), w.get("upper_percentile"), bounds=bounds)
        return out

    def moments(self, name: str, keys: list[str] | None = None) -> DataFrame:
        m = self._metric(name)
        if self.exp.cluster and not keys:
            return M.cluster_summary(self.totals(name), self.exp.cluster)
        return M.group_summary(self.totals(name), keys, binary=m.type in ("conversion", "retention"))

    @property
    def alpha(self) -> float:
        return self.exp.alpha / (len(self.exp.metrics) if self.exp.correction == "bonferroni" else 1)

    def _contrast(self, m: Metric, moments: DataFrame, keys: list[str] | None = None) -> DataFrame:
        none = F.lit(None).cast("string").alias("reason")
        if m.type == "ratio" or self.exp.cluster:
            r = effects.ratio_lift(moments, self.exp.control, self.alpha, keys)
            return r.select(*(keys or []), "group_id", F.col("ratio_treatment").alias("treatment"), F.col("ratio_control").alias("control"), "lift", "se", "lb", "ub", "reason")
        if m.n_pre_periods:
            r = effects.cuped(moments, self.exp.control, self.alpha, keys)
            return r.select(*(keys or []), "group_id", F.col("mean_treatment").alias("treatment"), F.col("mean_control").alias("control"), "lift", "se", "lb", "ub", none)
        r = effects.relative_lift(moments, self.exp.control, self.alpha, keys)
        return r.select(*(keys or []), "group_id", F.col("mean_treatment").alias("treatment"), F.col("mean_control").alias("control"), "lift", "se", "lb", "ub", "reason")

    def run(self, metrics: list[str] | None = None) -> DataFrame:
        """A row per metric and treated arm; what can't be estimated is a row with a reason.

        A mean with percentile winsorization has the influence of its estimated cut points in its error (`winsorized_lift`).
        """
        out = []
        none = F.lit(None).cast("string").alias("reason")
        for name in metrics or self.exp.metrics:
            m = self._metric(name)
            if m.type in ("total", "active"):
                raise EngineError("readout.report_only", f"{name!r} is for calendar reports", metric=name)
            w = m.winsorize or {}
            cut = w.get("lower_percentile"), w.get("upper_percentile")
            if m.type == "quantile":
                r = designs.quantile_lift(self.totals(name), m.q, self.exp.control, self.alpha)
                r = r.select("group_id", F.col("point").alias("treatment"), F.col("point_control").alias("control"), "lift", "se", "lb", "ub", none)
            elif m.type == "mean" and any(c is not None for c in cut) and not self.exp.cluster and not m.n_pre_periods:
                r = winsor.winsorized_lift(self.totals(name, clip=False), *cut, self.exp.control, self.alpha)
                r = r.select("group_id", F.col("mean_treatment").alias("treatment"), F.col("mean_control").alias("control"), "lift", "se", "lb", "ub", none)
            else:
                r = self._contrast(m, self.moments(name))
            out.append(r.select(F.lit(name).alias("metric"), *r.columns))
        return reduce(DataFrame.unionByName, out)

    def breakout(self, name: str, properties: list[str]) -> DataFrame:
        """Lift per segment of unit properties known before exposure, all properties in one pass; clusters are collapsed within
        each segment, and covariates adjust within it."""
        m = self._metric(name)
        if m.type == "quantile":
            raise EngineError("readout.breakout_quantile", "a quantile has no moments by segment", metric=name)
        totals = self.totals(name)
        for p in properties:
            source = next((s for s in self.defs.fact_sources.values() for q in s.properties if q.name == p and q.as_of != "event_time"), None)
            if source is None:
                raise EngineError("readout.breakout_property", f"{p!r} isn't known before exposure", property=p)
            as_of = next(q.as_of for q in source.properties if q.name == p)
            rows = self.facts(source)
            values = dims.static_property(rows, p) if as_of == "static" else dims.pre_exposure_property(self.exposures(), rows, p)
            totals = totals.join(values, "unit_id", "left")
        return self._contrast(m, segments.breakouts(totals, properties, self.exp.cluster), ["breakout", "segment"])

    def _day_axis(self, name: str) -> tuple[DataFrame, DataFrame, str, str]:
        """(exposures, the metric's unit-day statistics, last day, aggregation) of a metric that has a value for each day."""
        m = self._metric(name)
        if self.exp.cluster:
            raise EngineError("readout.day_cluster", "moments by day are of units; the experiment is clustered", cluster=self.exp.cluster)
        if m.type not in ("mean", "conversion") or m.winsorize:
            raise EngineError("readout.day_metric", f"{name!r} has no value for each day", metric=name, type=m.type)
        conditions = tuple((f["property"], f["op"], tuple(f["values"])) for f in m.filters)
        stats = self.stats(m.fact, conditions, m.type == "mean" and m.aggregation != "count")
        a, b = m.outcome.days
        stats = stats.filter(F.col("day_offset") >= a) if a else stats
        stats = stats.filter(F.col("day_offset") < b) if b is not None else stats
        return self.exposures(), stats, self.edge(m.fact), "conversion" if m.type == "conversion" else m.aggregation

    def daily(self, name: str) -> DataFrame:
        """Moments of each calendar day's value, of the metric's events inside its window."""
        return O.daily_moments(*self._day_axis(name))

    def asof(self, name: str) -> DataFrame:
        """Moments of the values cumulated to each calendar day, of the metric's events inside its window."""
        return O.asof_moments(*self._day_axis(name))

    def asof_lift(self, name: str, rho: float = 0.1) -> DataFrame:
        return effects.asymptotic_sequence(self.asof(name), self.exp.control, self.exp.alpha, rho)

    def srm(self) -> dict:
        counts = {r.group_id: r.n for r in X.arm_counts(self.exposures()).collect()}
        if not self.exp.allocation:
            raise EngineError("srm.no_allocation", "the experiment declares no allocation")
        return diagnostics.sample_ratio(counts, self.exp.allocation)

    def plan(self, name: str) -> str:
        """The physical plan of a metric's moments."""
        return self.moments(name)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def close(self) -> None:
        for df in [*self._stats.values(), *([self._exposures] if self._exposures is not None else [])]:
            df.unpersist()


def from_definitions(spark: SparkSession, where: str | Path | dict, experiment: str) -> Reader:
    """Bind declarations to a session whose catalog holds the tables that their queries read."""
    d = load_definitions(where)
    if experiment not in d.experiments:
        raise EngineError("definition.unknown_experiment", f"{experiment!r}", experiment=experiment)
    return Reader(spark, d, d.experiments[experiment])
