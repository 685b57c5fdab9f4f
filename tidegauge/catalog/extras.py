"""Queries of ratio adjustment, site-wide ratios, winsorized inference, simulation, formulas and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import effects as E
from ..functions import formula
from ..operators import designs as D
from ..operators import moments as M
from ..operators import outcomes as O
from ..operators import simulate, winsor
from .base import EDGE, events_of, exposures, query, rounded, stats_of, table
from .pipeline import _RATIO, _ratio, _sums


def _adjusted(spark, sf):
    pre = O.pre_period_stats(events_of(spark, sf, "purchase"), exposures(spark, sf), 5)
    return M.group_summary(_ratio(spark, sf).join(pre, "unit_id"))


_RC = _RATIO + ", p AS (SELECT x.unit_id, coalesce(sum(value), 0) AS x FROM x LEFT JOIN ev ON ev.unit_id = x.unit_id AND event = 'purchase' AND ev.ts < x.fts AND ev.ts::DATE >= x.fd - 5 GROUP BY 1), c AS (SELECT t.*, p.x FROM t JOIN p USING (unit_id))"


@query(_RC + """, a AS (SELECT group_id, count(*)::DOUBLE AS n, avg(y) AS my, avg(d) AS md, avg(x) AS mx, var_samp(x) / count(*) AS vx, covar_samp(x, y) / count(*) AS cy, covar_samp(x, d) / count(*) AS cd FROM c GROUP BY 1),
th AS (SELECT sum(cy) / sum(vx) AS ty, sum(cd) / sum(vx) AS td, sum(n * mx) / sum(n) AS anchor FROM a), j AS (SELECT group_id, (my - ty * (mx - anchor)) / (md - td * (mx - anchor)) AS r FROM a, th)
SELECT t.group_id, round(t.r, 6) AS ratio_treatment, round(c.r, 6) AS ratio_control, round(t.r / c.r - 1, 6) AS lift FROM j t, j c WHERE t.group_id = 'treatment' AND c.group_id = 'control'""")
def ratio_cuped(spark, sf):
    return rounded(E.ratio_cuped(_adjusted(spark, sf), "control").select("group_id", "ratio_treatment", "ratio_control", "lift"))


@query(_RATIO + """, a AS (SELECT group_id, count(*)::DOUBLE AS n, avg(y) AS my, avg(d) AS md FROM t GROUP BY 1), v AS (SELECT sum(value) FILTER (event = 'purchase') AS num, count(*) FILTER (event = 'click')::DOUBLE AS den, count(DISTINCT user_id)::DOUBLE AS s FROM ev),
b AS (SELECT t.group_id, t.my - c.my AS a, t.md - c.md AS b, t.n AS nt, num, den, s FROM a t, a c, v WHERE t.group_id = 'treatment' AND c.group_id = 'control'), z AS (SELECT *, num - a * nt AS n0, den - b * nt AS d0 FROM b)
SELECT group_id, round(n0 / d0, 6) AS without, round((n0 + a * s) / (d0 + b * s), 6) AS with_all, round((n0 + a * s) / (d0 + b * s) - n0 / d0, 6) AS impact FROM z""")
def sitewide_ratio(spark, sf):
    from .base import facts

    f = facts(spark, sf)
    volume = f.agg(F.sum(F.when(F.col("event") == "purchase", F.col("value"))).alias("num"), F.count_if(F.col("event") == "click").cast("double").alias("den"), F.count_distinct("unit_id").cast("double").alias("n_site"))
    return rounded(E.sitewide_ratio(M.group_summary(_ratio(spark, sf)), "control", volume).drop("se"))


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_id, o_totalprice / 1000 AS y FROM orders), q AS (SELECT quantile_cont(y, 0.99) AS hi FROM t), m AS (SELECT group_id, avg(least(y, hi)) AS m FROM t, q GROUP BY 1)
SELECT t.group_id, round(t.m, 6) AS mean_treatment, round(c.m, 6) AS mean_control, round(t.m / c.m - 1, 6) AS lift FROM m t, m c WHERE t.group_id = 'treatment' AND c.group_id = 'control'""")
def winsorized_lift(spark, sf):
    t = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("treatment").alias("group_id"), (F.col("o_totalprice") / 1000).alias("y"))
    return rounded(winsor.winsorized_lift(t, None, 0.99, "control").select("group_id", "mean_treatment", "mean_control", "lift"))


@query(None)
def simulated_switchback(spark, sf):
    steps = simulate.switchback_steps(spark, 200, 4, 6, effect=1.0)
    return rounded(D.switchback_effect(D.switchback_contributions(D.switchback_periods(steps))))


@query(None)
def simulated_experiment(spark, sf):
    from ..operators import exposures as X

    log = simulate.raw_logs(spark, 20_000, lift=0.2)
    e = X.first_exposures(log.filter("event = 'exposure'"))
    s = O.post_exposure_stats(O.metric_events(log, "purchase", "value", missing="skip"), e)
    return rounded(E.relative_lift(M.group_summary(O.unit_totals(e, s, O.Outcome("mean", "sum", 7), "2025-01-14")), "control"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / nullif(count(*), 0), 4) AS net_per_line FROM lineitem GROUP BY 1")
def metric_formula(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_source")
    sql = formula.metric_sql("net_per_line", {"net": "sum(l_extendedprice * (1 - l_discount))", "lines": "count(*)"}, "net / lines", "lineitem_source", ["l_returnflag"])
    return spark.sql(sql).withColumn("net_per_line", F.round("net_per_line", 4))
