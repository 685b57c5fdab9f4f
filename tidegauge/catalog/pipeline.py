"""Queries of the experiment pipeline: exposures, outcomes, totals, moments, day axis, breakouts, clusters, uptake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import effects as E
from ..operators import cleaning, dims
from ..operators import exposures as X
from ..operators import moments as M
from ..operators import outcomes as O
from .base import BASE, EDGE, END, START, events_of, exposure_rows, exposures, facts, moments_sql, query, rounded, rounded_moments, stats_of, stats_sql, table


@query(BASE + "z AS (SELECT 1) SELECT NULL::VARCHAR AS experiment_id, unit_id, group_id, fts AS first_exposure_ts, fd AS first_exposure_date FROM x")
def first_exposures(spark, sf):
    return exposures(spark, sf)


@query(BASE + "u AS (SELECT unit_id, count(DISTINCT group_id) AS a FROM xr GROUP BY 1) SELECT count(*) AS units, count(*) FILTER (a > 1) AS mixed_units, 0::BIGINT AS null_arm_rows FROM u")
def mixed_assignment(spark, sf):
    rows = X.enrolling_rows(exposure_rows(spark, sf), None, START, END)
    return X.mixed_assignment_snapshot(rows)


@query(BASE + "z AS (SELECT 1) SELECT group_id, count(*) AS n FROM x GROUP BY 1")
def arm_counts(spark, sf):
    return X.arm_counts(exposures(spark, sf))


@query(BASE + """d AS (SELECT fd AS ds, group_id, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT r.ds::DATE AS ds, a.group_id FROM (SELECT unnest(generate_series((SELECT min(fd) FROM x), (SELECT max(fd) FROM x), INTERVAL 1 DAY)) AS ds) r, (SELECT DISTINCT group_id FROM x) a)
SELECT g.ds, g.group_id, coalesce(n, 0) AS n_daily, sum(coalesce(n, 0)) OVER (PARTITION BY g.group_id ORDER BY g.ds)::BIGINT AS n_cumulative FROM g LEFT JOIN d USING (ds, group_id)""")
def daily_exposure_counts(spark, sf):
    return X.daily_exposure_counts(exposures(spark, sf))


@query("SELECT user_id::VARCHAR AS unit_id, ts::DATE AS ds, count(*) AS n_events, round(sum(value), 6) AS sum_value, min(value) AS min_value, max(value) AS max_value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY ALL")
def unit_day_stats(spark, sf):
    s = O.unit_day_stats(events_of(spark, sf, "purchase"))
    return s.withColumn("sum_value", F.round("sum_value", 6))


@query(BASE + stats_sql("st", "purchase") + " SELECT unit_id, group_id, ds, off::INT AS day_offset, n AS n_events, round(s, 6) AS sum_value, lo AS min_value, hi AS max_value FROM st")
def post_exposure_stats(spark, sf):
    return stats_of(spark, sf, "purchase").withColumn("sum_value", F.round("sum_value", 6))


@query(BASE + "p AS (SELECT x.unit_id, sum(value) AS s FROM ev JOIN x USING (unit_id) WHERE event = 'purchase' AND ev.ts < x.fts AND ev.ts::DATE >= x.fd - 3 GROUP BY 1) SELECT x.unit_id, round(coalesce(s, 0), 6) AS x FROM x LEFT JOIN p USING (unit_id)")
def pre_period_covariate(spark, sf):
    return rounded(O.pre_period_stats(events_of(spark, sf, "purchase"), exposures(spark, sf), 3))


_AGG = {"sum": "coalesce(sum(s), 0)", "count": "coalesce(sum(n), 0)::DOUBLE", "count_distinct": "count(DISTINCT s)::DOUBLE", "avg_event": "sum(s) / sum(n)", "avg_calendar_day": "coalesce(sum(s), 0) / 7", "min": "min(lo)", "max": "max(hi)"}


def _totals_sql(agg: str) -> str:
    return BASE + stats_sql("st", "purchase") + f", t AS (SELECT x.unit_id, x.group_id, {_AGG[agg]} AS y FROM x LEFT JOIN st ON st.unit_id = x.unit_id AND st.off < 7 WHERE x.fd + 6 <= DATE '{EDGE}' GROUP BY ALL)"


def _register_aggregations():
    for agg in _AGG:
        def totals(spark, sf, agg=agg):
            t = O.unit_totals(exposures(spark, sf), stats_of(spark, sf, "purchase"), O.Outcome("mean", agg, 7), EDGE)
            return rounded(t.select("unit_id", "group_id", "y"))

        def summary(spark, sf, agg=agg):
            return rounded_moments(M.group_summary(O.unit_totals(exposures(spark, sf), stats_of(spark, sf, "purchase"), O.Outcome("mean", agg, 7), EDGE)))

        query(_totals_sql(agg) + " SELECT unit_id, group_id, round(y, 6) AS y FROM t", f"unit_totals_{agg}")(totals)
        query(_totals_sql(agg) + " " + moments_sql("t"), f"group_summary_{agg}")(summary)


_register_aggregations()


def _binary_sql(event: str, band: str, last: int) -> str:
    return BASE + stats_sql("st", event, "1.0") + f", t AS (SELECT x.unit_id, x.group_id, x.fd, (count(st.unit_id) > 0)::INT::DOUBLE AS y FROM x LEFT JOIN st ON st.unit_id = x.unit_id AND {band} WHERE x.fd + {last} <= DATE '{EDGE}' GROUP BY ALL)"


def _binary_query(name, outcome, band, last):
    def totals(spark, sf):
        t = O.unit_totals(exposures(spark, sf), stats_of(spark, sf, "purchase", None), outcome, EDGE)
        return rounded_moments(M.group_summary(t, binary=True))

    query(_binary_sql("purchase", band, last) + " SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, 0.0::DOUBLE AS cy1, round(count(*) * var_pop(y), 4) AS cy2, count(*) FILTER (y = 1) AS successes, 0::BIGINT AS nonbinary FROM t GROUP BY 1", name)(totals)


_binary_query("conversion_summary", O.Outcome("conversion", window=2), "st.off < 2", 1)
_binary_query("retention_band_summary", O.Outcome("retention", band=(2, 4)), "st.off >= 2 AND st.off < 4", 3)
_binary_query("retention_open_summary", O.Outcome("retention", band=(7, None)), "st.off >= 7", 7)


@query(BASE + stats_sql("st", "purchase", "1.0") + f", t AS (SELECT x.unit_id, x.group_id, x.fd, (count(st.unit_id) > 0)::INT::DOUBLE AS y FROM x LEFT JOIN st ON st.unit_id = x.unit_id AND st.off >= 1 AND st.off < 3 WHERE x.fd + 2 <= DATE '{EDGE}' GROUP BY ALL) SELECT fd AS first_exposure_date, group_id, count(*) AS n, round(avg(y), 6) AS ref_y, 0.0::DOUBLE AS cy1, round(count(*) * var_pop(y), 4) AS cy2, count(*) FILTER (y = 1) AS successes, 0::BIGINT AS nonbinary FROM t GROUP BY ALL")
def cohort_retention(spark, sf):
    return rounded_moments(O.cohort_retention(exposures(spark, sf), stats_of(spark, sf, "purchase", None), O.Outcome("retention", band=(1, 3)), EDGE))


@query(BASE + stats_sql("st", "purchase", "1.0") + f", o AS (SELECT DISTINCT unit_id FROM st WHERE off < 3) SELECT group_id, count(*) AS assigned, count(*) FILTER (fd + 2 <= DATE '{EDGE}') AS eligible, count(*) FILTER (NOT fd + 2 <= DATE '{EDGE}') AS not_mature, count(*) FILTER (fd + 2 <= DATE '{EDGE}' AND o.unit_id IS NULL) AS no_observed FROM x LEFT JOIN o USING (unit_id) GROUP BY 1")
def eligibility_accounts(spark, sf):
    return O.eligibility(exposures(spark, sf), stats_of(spark, sf, "purchase", None), O.Outcome("conversion", window=3), EDGE)


@query(BASE + stats_sql("st", "purchase") + f""", sp AS (SELECT unit_id, group_id, fd, unnest(range(0, least(date_diff('day', fd, DATE '{EDGE}'), 6) + 1))::INT AS day_offset FROM x)
SELECT sp.unit_id, sp.group_id, (sp.fd + sp.day_offset)::DATE AS ds, sp.day_offset, coalesce(n, 0) AS n_events, round(coalesce(s, 0), 6) AS sum_value, lo AS min_value, hi AS max_value FROM sp LEFT JOIN st ON st.unit_id = sp.unit_id AND st.off = sp.day_offset""")
def unit_day_panel(spark, sf):
    p = O.panel(exposures(spark, sf), stats_of(spark, sf, "purchase"), EDGE, 7)
    return p.withColumn("sum_value", F.round("sum_value", 6))


_TOT = BASE + stats_sql("st", "purchase") + f", t AS (SELECT x.unit_id, x.group_id, x.cluster_id, coalesce(sum(s), 0) AS y FROM x LEFT JOIN st ON st.unit_id = x.unit_id AND st.off < 7 WHERE x.fd + 6 <= DATE '{EDGE}' GROUP BY ALL)"


def _sums(spark, sf, carry=()):
    return O.unit_totals(exposures(spark, sf, carry), stats_of(spark, sf, "purchase"), O.Outcome("mean", "sum", 7), EDGE)


@query(_TOT + """, q AS (SELECT quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM t), w AS (SELECT group_id, greatest(least(y, hi), lo) AS y, lo, hi, y < lo AS a, y > hi AS b FROM t, q)
SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, round(count(*) * var_pop(y), 4) AS cy2, round(max(lo), 6) AS lower_bound, round(max(hi), 6) AS upper_bound, count(*) FILTER (a) AS n_lower, count(*) FILTER (b) AS n_upper FROM w GROUP BY 1""")
def winsorized_summary(spark, sf):
    w = O.winsorize(_sums(spark, sf), 0.1, 0.9)
    return w.groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("ref_y"), F.round(F.count("*") * F.var_pop("y"), 4).alias("cy2"), F.round(F.max("winsor_lower_bound"), 6).alias("lower_bound"), F.round(F.max("winsor_upper_bound"), 6).alias("upper_bound"), F.count_if("winsor_low").alias("n_lower"), F.count_if("winsor_high").alias("n_upper"))


@query(_TOT + " SELECT group_id, count(*) AS n, round(avg(least(y, 100)), 6) AS ref_y FROM t GROUP BY 1")
def winsorized_fixed_bound(spark, sf):
    return rounded(O.winsorize(_sums(spark, sf), bounds=(None, 100.0)).groupBy("group_id").agg(F.count("*").alias("n"), F.avg("y").alias("ref_y")))


_LIFT = """, m AS (SELECT group_id, count(y) AS n, avg(y) AS m, var_samp(y) AS v FROM {source} GROUP BY 1),
l AS (SELECT t.group_id, t.n AS n_treatment, c.n AS n_control, t.m AS mean_treatment, c.m AS mean_control, ln(t.m / c.m) AS p, sqrt(t.v / (t.n * t.m * t.m) + c.v / (c.n * c.m * c.m)) AS se FROM m t, m c WHERE t.group_id = 'treatment' AND c.group_id = 'control')
SELECT group_id, n_treatment, n_control, round(mean_treatment, 6) AS mean_treatment, round(mean_control, 6) AS mean_control, CASE WHEN se >= 0.5 THEN 'too_wide' END AS reason, CASE WHEN se < 0.5 THEN round(exp(p) - 1, 6) END AS lift, CASE WHEN se < 0.5 THEN round(se, 6) END AS se,
       CASE WHEN se < 0.5 THEN round(exp(p - 1.959963984540054 * se) - 1, 6) END AS lb, CASE WHEN se < 0.5 THEN round(exp(p + 1.959963984540054 * se) - 1, 6) END AS ub FROM l"""


@query(_TOT + _LIFT.format(source="t"))
def lift_mean(spark, sf):
    return rounded(E.relative_lift(M.group_summary(_sums(spark, sf)), "control"))


@query(_binary_sql("purchase", "st.off < 2", 1) + _LIFT.format(source="t"))
def lift_conversion(spark, sf):
    t = O.unit_totals(exposures(spark, sf), stats_of(spark, sf, "purchase", None), O.Outcome("conversion", window=2), EDGE)
    return rounded(E.relative_lift(M.group_summary(t), "control"))


@query(_TOT + ", m AS (SELECT group_id, count(y) AS n, avg(y) AS m, var_samp(y) / count(y) AS v FROM t GROUP BY 1) SELECT t.group_id, round(t.m - c.m, 6) AS diff, round(sqrt(t.v + c.v), 6) AS se, round(pow(t.v + c.v, 2) / (t.v * t.v / (t.n - 1) + c.v * c.v / (c.n - 1)), 6) AS df FROM m t, m c WHERE t.group_id = 'treatment' AND c.group_id = 'control'")
def welch_difference(spark, sf):
    return rounded(E.absolute_difference(M.group_summary(_sums(spark, sf)), "control"))


_RATIO = BASE + stats_sql("st", "purchase") + ", " + stats_sql("sc", "click", "1.0") + f""", t AS (SELECT x.unit_id, x.group_id, coalesce((SELECT sum(s) FROM st WHERE st.unit_id = x.unit_id AND off < 7), 0)::DOUBLE AS y, coalesce((SELECT sum(n) FROM sc WHERE sc.unit_id = x.unit_id AND off < 7), 0)::DOUBLE AS d FROM x WHERE x.fd + 6 <= DATE '{EDGE}')"""


def _ratio(spark, sf):
    return O.ratio_totals(exposures(spark, sf), stats_of(spark, sf, "purchase"), stats_of(spark, sf, "click", None), O.Outcome("mean", "sum", 7), O.Outcome("mean", "count", 7), EDGE)


@query(_RATIO + " SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, round(avg(d), 6) AS ref_den, round(count(*) * var_pop(y), 4) AS cy2, round(count(*) * var_pop(d), 4) AS cden2, round(count(*) * covar_pop(y, d), 4) AS cyden, round(sum(pow(d - md, 3)), 4) AS cden3 FROM (SELECT *, avg(d) OVER (PARTITION BY group_id) AS md FROM t) q GROUP BY 1")
def ratio_summary(spark, sf):
    return rounded_moments(M.group_summary(_ratio(spark, sf))).select("group_id", "n", "ref_y", "ref_den", "cy2", "cden2", "cyden", "cden3")


@query(_RATIO + """, a AS (SELECT group_id, count(*) AS n, avg(y) AS my, avg(d) AS md, var_samp(y) AS vy, var_samp(d) AS vd, covar_samp(y, d) AS c FROM t GROUP BY 1),
b AS (SELECT *, my / md AS r, (vy / (my * my) + vd / (md * md) - 2 * c / (my * md)) / n AS vl, (vy - 2 * my / md * c + my / md * my / md * vd) / (n * md * md) AS va, sqrt(vd / n) / md AS pr FROM a)
SELECT t.group_id, round(t.r, 6) AS ratio_treatment, round(c.r, 6) AS ratio_control, round(greatest(t.pr, c.pr), 6) AS denominator_precision, CASE WHEN sqrt(t.vl + c.vl) < 0.5 THEN round(t.r / c.r - 1, 6) END AS lift, CASE WHEN sqrt(t.vl + c.vl) < 0.5 THEN round(sqrt(t.vl + c.vl), 6) END AS se, round(t.r - c.r, 6) AS diff, round(sqrt(t.va + c.va), 6) AS diff_se FROM b t, b c WHERE t.group_id = 'treatment' AND c.group_id = 'control'""")
def lift_ratio(spark, sf):
    m = M.group_summary(_ratio(spark, sf))
    a = E.ratio_lift(m, "control").select("group_id", "ratio_treatment", "ratio_control", "denominator_precision", "lift", "se")
    return rounded(a.join(E.ratio_difference(m, "control").withColumnRenamed("se", "diff_se"), "group_id"))


_CUPED = _TOT + ", p AS (SELECT x.unit_id, coalesce(sum(value), 0) AS x FROM x LEFT JOIN ev ON ev.unit_id = x.unit_id AND event = 'purchase' AND ev.ts < x.fts AND ev.ts::DATE >= x.fd - 5 GROUP BY 1), c AS (SELECT t.*, p.x FROM t JOIN p USING (unit_id))"


def _with_covariate(spark, sf):
    pre = O.pre_period_stats(events_of(spark, sf, "purchase"), exposures(spark, sf), 5)
    return _sums(spark, sf).join(pre, "unit_id")


@query(_CUPED + " SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, round(avg(x), 6) AS ref_x, round(count(*) * var_pop(y), 4) AS cy2, round(count(*) * var_pop(x), 4) AS cx2, round(count(*) * covar_pop(x, y), 4) AS cxy FROM c GROUP BY 1")
def covariate_summary(spark, sf):
    return rounded_moments(M.group_summary(_with_covariate(spark, sf))).select("group_id", "n", "ref_y", "ref_x", "cy2", "cx2", "cxy")


@query(_CUPED + """, a AS (SELECT group_id, count(*)::DOUBLE AS n, avg(y) AS my, avg(x) AS mx, var_samp(y) AS vy, var_samp(x) AS vx, covar_samp(x, y) AS cxy FROM c GROUP BY 1),
th AS (SELECT sum(cxy / n) / sum(vx / n) AS theta, sum(n * mx) / sum(n) AS anchor, sum(n) AS total FROM a), j AS (SELECT a.*, theta, my - theta * (mx - anchor) AS j, n / total AS w FROM a, th)
SELECT t.group_id, round(t.theta, 6) AS theta, round(t.j, 6) AS mean_treatment, round(c.j, 6) AS mean_control, round(t.j - c.j, 6) AS diff,
       round(sqrt((t.vy - 2 * t.theta * t.cxy + t.theta * t.theta * t.vx) / t.n + (c.vy - 2 * c.theta * c.cxy + c.theta * c.theta * c.vx) / c.n), 6) AS diff_se, round(t.j / c.j - 1, 6) AS lift,
       round(sqrt((t.vy - 2 * (t.theta * (c.w + t.w * t.j / c.j)) * t.cxy + pow(t.theta * (c.w + t.w * t.j / c.j), 2) * t.vx) / t.n / (t.j * t.j) + (c.vy - 2 * (t.theta * (t.w + c.w * c.j / t.j)) * c.cxy + pow(t.theta * (t.w + c.w * c.j / t.j), 2) * c.vx) / c.n / (c.j * c.j)), 6) AS se FROM j t, j c WHERE t.group_id = 'treatment' AND c.group_id = 'control'""")
def cuped_lift(spark, sf):
    return rounded(E.cuped(M.group_summary(_with_covariate(spark, sf)), "control").drop("lb", "ub"))


@query(_TOT + ", g AS (SELECT group_id, cluster_id, sum(y) AS y, count(*)::DOUBLE AS d FROM t GROUP BY ALL) SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, round(avg(d), 6) AS ref_den, round(avg(d), 6) AS ref_x, round(count(*) * var_pop(y), 4) AS cy2, round(count(*) * var_pop(d), 4) AS cden2, round(count(*) * covar_pop(y, d), 4) AS cyden, 'cluster_size' AS x_role FROM g GROUP BY 1")
def cluster_summary(spark, sf):
    return rounded_moments(M.cluster_summary(_sums(spark, sf, ("cluster_id",)))).select("group_id", "n", "ref_y", "ref_den", "ref_x", "cy2", "cden2", "cyden", "x_role")


@query(BASE + "z AS (SELECT 1) SELECT group_id, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_units FROM x GROUP BY 1")
def cluster_exposure_counts(spark, sf):
    return X.cluster_exposure_counts(exposures(spark, sf, ("cluster_id",)), "cluster_id")


@query(BASE + "z AS (SELECT 1) SELECT cluster_id, count(DISTINCT group_id) AS arms FROM x GROUP BY 1 HAVING count(DISTINCT group_id) > 1")
def cluster_label_check(spark, sf):
    return X.validate_clusters(exposures(spark, sf, ("cluster_id",)), "cluster_id")


_UPTAKE = _TOT + f", d AS (SELECT DISTINCT x.unit_id FROM x JOIN ev ON ev.unit_id = x.unit_id AND ev.event = 'signup' AND ev.ts >= x.fts AND date_diff('day', x.fd, ev.ts::DATE) < 3), u AS (SELECT t.*, (d.unit_id IS NOT NULL)::INT::DOUBLE AS d FROM t LEFT JOIN d USING (unit_id))"


def _uptake(spark, sf):
    d = X.uptake(exposures(spark, sf), events_of(spark, sf, "signup", None), 3).select("unit_id", "d")
    return _sums(spark, sf).join(d, "unit_id")


@query(_UPTAKE + " SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, round(count(*) * var_pop(y), 4) AS cy2, sum(d) AS sum_d, round(sum(d * (y - m)), 4) AS cyd, round(sum(d * (y - m) * (y - m)), 4) AS cy2d FROM (SELECT *, avg(y) OVER (PARTITION BY group_id) AS m FROM u) q GROUP BY 1")
def uptake_summary(spark, sf):
    return rounded_moments(M.group_summary(_uptake(spark, sf))).drop("cy1")


@query(_UPTAKE + " SELECT group_id, count(*) AS n, sum(d) AS takers, round(avg(d), 6) AS uptake FROM u GROUP BY 1")
def compliance(spark, sf):
    return rounded(X.compliance(_uptake(spark, sf)))


@query(_UPTAKE + """, a AS (SELECT group_id, count(*)::DOUBLE AS n, avg(y) AS my, avg(d) AS md, var_samp(y) / count(*) AS vy, var_samp(d) / count(*) AS vd, covar_samp(y, d) / count(*) AS c FROM u GROUP BY 1),
b AS (SELECT t.group_id, t.my - c.my AS itt, t.vy + c.vy AS va, t.md - c.md AS fs, t.vd + c.vd AS vb, t.c + c.c AS cab FROM a t, a c WHERE t.group_id = 'treatment' AND c.group_id = 'control')
SELECT group_id, round(itt, 6) AS itt, round(sqrt(va), 6) AS itt_se, round(fs, 6) AS first_stage, round(sqrt(vb), 6) AS first_stage_se, round(itt / nullif(fs, 0), 4) AS late, round(sqrt(va - 2 * (itt / fs) * cab + pow(itt / fs, 2) * vb) / abs(nullif(fs, 0)), 4) AS late_se FROM b""")
def encouragement_late(spark, sf):
    r = rounded(E.late(M.group_summary(_uptake(spark, sf)), "control"))
    return r.withColumns({"late": F.round("late", 4), "late_se": F.round("late_se", 4)})


@query(BASE + f"tr AS (SELECT x.unit_id, x.group_id, x.fts, x.fd, min(ev.ts) AS tts FROM x JOIN ev USING (unit_id) WHERE event = 'click' AND ev.ts >= x.fts AND ev.ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL) SELECT NULL::VARCHAR AS experiment_id, unit_id, group_id, fts AS first_exposure_ts, fd AS first_exposure_date, tts AS first_trigger_ts FROM tr")
def triggered_population(spark, sf):
    return X.triggered_population(exposures(spark, sf), facts(spark, sf).filter("event = 'click'"), "2024-01-10 00:00:00")


@query(BASE + "tr AS (SELECT DISTINCT x.unit_id FROM x JOIN ev USING (unit_id) WHERE event = 'click' AND ev.ts >= x.fts AND ev.ts <= TIMESTAMP '2024-01-06 00:00:00') SELECT group_id, count(*) AS n_exposed, count(tr.unit_id) AS n_triggered, round(count(tr.unit_id) / count(*), 6) AS rate FROM x LEFT JOIN tr USING (unit_id) GROUP BY 1")
def trigger_rates(spark, sf):
    e = exposures(spark, sf)
    return rounded(X.trigger_rates(e, X.triggered_population(e, facts(spark, sf).filter("event = 'click'"), "2024-01-06 00:00:00")))


_GRID = f"gr AS (SELECT r.ds::DATE AS ds, x.unit_id, x.group_id FROM (SELECT unnest(generate_series((SELECT min(fd) FROM x), DATE '{EDGE}', INTERVAL 1 DAY)) AS ds) r JOIN x ON x.fd <= r.ds::DATE)"


@query(BASE + stats_sql("st", "purchase") + ", " + _GRID + ", t AS (SELECT gr.ds, gr.group_id, coalesce(s, 0) AS y FROM gr LEFT JOIN st ON st.unit_id = gr.unit_id AND st.ds = gr.ds) " + moments_sql("t", "ds, group_id"))
def daily_moments(spark, sf):
    return rounded_moments(O.daily_moments(exposures(spark, sf), stats_of(spark, sf, "purchase"), EDGE))


_ASOF = BASE + stats_sql("st", "purchase") + ", " + _GRID + ", t AS (SELECT gr.ds, gr.group_id, gr.unit_id, coalesce(sum(s), 0) AS y FROM gr LEFT JOIN st ON st.unit_id = gr.unit_id AND st.ds <= gr.ds GROUP BY ALL)"


@query(_ASOF + " SELECT ds, group_id, count(*) AS n, round(avg(y), 4) AS ref_y, round(sqrt(var_pop(y)), 4) AS sd FROM t GROUP BY ALL")
def asof_moments(spark, sf):
    m = O.asof_moments(exposures(spark, sf), stats_of(spark, sf, "purchase"), EDGE)
    return m.select("ds", "group_id", "n", F.round("ref_y", 4).alias("ref_y"), F.round(F.sqrt(F.col("cy2") / F.col("n")), 4).alias("sd"))


@query(_ASOF + """, a AS (SELECT ds, group_id, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) / count(*) AS v FROM t GROUP BY ALL),
b AS (SELECT t.ds, t.group_id, t.n + c.n AS n, t.m - c.m AS diff, sqrt(t.v + c.v) AS se FROM a t JOIN a c ON t.ds = c.ds AND t.group_id = 'treatment' AND c.group_id = 'control'),
k AS (SELECT *, se * sqrt((1 + 100 / n) * (ln(1 + n / 100) - 2 * ln(0.05))) AS h FROM b)
SELECT ds, group_id, n::BIGINT AS n, round(diff, 4) AS diff, round(se, 4) AS se, round(h, 4) AS half_width, round(diff - h, 4) AS lb, round(diff + h, 4) AS ub FROM k WHERE se > 0""")
def sequential_looks(spark, sf):
    m = O.asof_moments(exposures(spark, sf), stats_of(spark, sf, "purchase"), EDGE)
    return rounded(E.asymptotic_sequence(m, "control"), 4).filter("se > 0")


@query(_TOT + """, a AS (SELECT group_id, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) / count(*) AS v FROM t GROUP BY 1), v AS (SELECT sum(value) AS total, count(DISTINCT user_id)::DOUBLE AS n_site FROM ev WHERE event = 'purchase'),
b AS (SELECT t.group_id, t.m - c.m AS delta, sqrt(t.v + c.v) AS se, t.n AS nt, total, n_site, total - (t.m - c.m) * t.n AS base FROM a t, a c, v WHERE t.group_id = 'treatment' AND c.group_id = 'control')
SELECT group_id, round(delta, 6) AS delta, round(delta * n_site, 4) AS impact, round(delta * n_site / base, 6) AS relative_impact, round(abs(n_site * total / (base * base)) * se, 6) AS relative_se FROM b""")
def sitewide_impact(spark, sf):
    volume = events_of(spark, sf, "purchase").agg(F.sum("value").alias("total"), F.count_distinct("unit_id").cast("double").alias("n_site"))
    r = rounded(E.sitewide(M.group_summary(_sums(spark, sf)), "control", volume))
    return r.withColumn("impact", F.round("impact", 4))


@query(BASE + "ob AS (SELECT ev.unit_id, max(struct_pack(t := ev.ts, k := ev.k)).k AS k FROM ev JOIN x USING (unit_id) WHERE ev.ts < x.fts GROUP BY 1) SELECT x.unit_id, ob.k FROM x LEFT JOIN ob USING (unit_id)")
def pre_exposure_property(spark, sf):
    return dims.pre_exposure_property(exposures(spark, sf), facts(spark, sf), "k")


@query(_TOT + ", s AS (SELECT t.*, coalesce((t.unit_id::BIGINT % 5)::VARCHAR, '<missing>') AS segment FROM t) " + moments_sql("s", "segment, group_id"))
def breakout_moments(spark, sf):
    t = _sums(spark, sf).withColumn("segment", (F.col("unit_id").cast("long") % 5).cast("string"))
    return rounded_moments(M.group_summary(t, ["segment", "group_id"]))


@query(_TOT + ", s AS (SELECT t.*, (t.unit_id::BIGINT % 3)::VARCHAR AS a, (t.unit_id::BIGINT % 4)::VARCHAR AS b FROM t) SELECT 'a' AS breakout, a AS segment, group_id, count(y) AS n, round(avg(y), 6) AS ref_y FROM s GROUP BY a, group_id UNION ALL SELECT 'b', b, group_id, count(y), round(avg(y), 6) FROM s GROUP BY b, group_id")
def breakouts_in_one_pass(spark, sf):
    from ..operators.segments import breakouts

    t = _sums(spark, sf).withColumns({"a": (F.col("unit_id").cast("long") % 3).cast("string"), "b": (F.col("unit_id").cast("long") % 4).cast("string")})
    return rounded(breakouts(t, ["a", "b"]).select("breakout", "segment", "group_id", "n", "ref_y"))


@query(_TOT + ", s AS (SELECT group_id, (unit_id::BIGINT % 7)::INT AS part, y FROM t) SELECT group_id, count(y) AS n, round(avg(y), 6) AS ref_y, round(count(y) * var_pop(y), 4) AS cy2 FROM s GROUP BY 1")
def merged_moments(spark, sf):
    parts = M.group_summary(_sums(spark, sf).withColumn("part", F.col("unit_id").cast("long") % 7), ["group_id", "part"])
    return rounded_moments(M.merge(parts, ["group_id"])).drop("cy1")


@query("SELECT l_returnflag AS group_id, count(*) AS n, round(avg(l_quantity), 6) AS ref_y, 0.0::DOUBLE AS cy1, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def moments_from_summaries(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("group_id")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.var_samp("l_quantity").alias("var"))
    m = M.from_summaries(s)
    return rounded(m.select("group_id", "n", "ref_y", "cy1", (F.col("cy2") / (F.col("n") - 1)).alias("var")))


@query(BASE + "r AS (SELECT unit_id FROM x WHERE unit_id::BIGINT % 3 <> 0 UNION ALL SELECT DISTINCT unit_id FROM ev WHERE user_id % 11 = 0), u AS (SELECT unit_id, count(*) AS times FROM r GROUP BY 1) SELECT count(times) AS roster_units, count(*) FILTER (times > 1) AS duplicates, count(*) FILTER (times IS NOT NULL AND x.unit_id IS NULL) AS not_enrolled, count(*) FILTER (times IS NULL) AS not_on_roster FROM u FULL JOIN x ON u.unit_id = x.unit_id")
def roster_check(spark, sf):
    e = exposures(spark, sf)
    roster = e.filter("cast(unit_id as bigint) % 3 <> 0").select("unit_id").union(facts(spark, sf).filter("user_id % 11 = 0").select("unit_id").distinct())
    return X.check_roster(e, roster)


@query("SELECT 'demo' AS experiment_id, user_id::VARCHAR AS unit_id, ts::DATE AS period, max(struct_pack(v := event_id, g := event_type)).g AS group_id, max(event_id) AS version FROM events GROUP BY ALL")
def assignment_ledger(spark, sf):
    rows = facts(spark, sf).select(F.lit("demo").alias("experiment_id"), "unit_id", F.to_date("ts").alias("period"), F.col("event").alias("group_id"), F.col("event_id").alias("version"))
    return X.reduce_ledger(rows)


@query("WITH l AS (SELECT 'demo' AS experiment_id, user_id::VARCHAR AS unit_id, ts::DATE AS period, max(struct_pack(v := event_id, g := event_type)).g AS group_id, max(event_id) AS version FROM events GROUP BY ALL) SELECT *, lead(group_id) OVER (PARTITION BY experiment_id, unit_id ORDER BY period) AS next_group_id FROM l")
def ledger_exposures(spark, sf):
    return X.ledger_exposures(assignment_ledger(spark, sf))


@query(BASE + "z AS (SELECT 1) SELECT unit_id, ts, value FROM ev WHERE event = 'purchase' AND k >= 5 AND k < 50 AND k <> 7")
def filtered_events(spark, sf):
    return O.metric_events(facts(spark, sf), "purchase", "value", [("k", "gte", [5]), ("k", "lt", [50]), ("k", "not_equals", [7])], "zero").filter("value IS NOT NULL")


@query("SELECT count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isnan(value)) AS nans, count(*) FILTER (isinf(value)) AS infinities FROM events")
def non_finite_counts(spark, sf):
    return cleaning.non_finite_counts(table(spark, sf, "events"), "value")


_GAPS = "WITH g AS (SELECT o_orderkey, o_orderstatus AS group_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) "


def _gaps(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("group_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("v"))


@query(_GAPS + "SELECT o_orderkey, round(coalesce(v, (SELECT avg(v) FROM g)), 4) AS v FROM g")
def impute_pooled_mean(spark, sf):
    return cleaning.pooled_mean(_gaps(spark, sf), ["v"]).select("o_orderkey", F.round("v", 4).alias("v"))


@query(_GAPS + "SELECT group_id, count(*) AS n, round(sum(coalesce(v, 0)) / count(*), 4) AS m FROM g GROUP BY 1")
def impute_zeros(spark, sf):
    return cleaning.zeros(_gaps(spark, sf), ["v"]).groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.sum("v") / F.count("*"), 4).alias("m"))


@query(_GAPS + "SELECT group_id, count(*) AS n, count(*) FILTER (v IS NULL) AS missing_v FROM g GROUP BY 1")
def missing_accounts(spark, sf):
    return cleaning.missing_accounts(_gaps(spark, sf), ["v"])


@query(_GAPS + "SELECT o_orderkey, group_id, v FROM g WHERE v IS NOT NULL")
def drop_null(spark, sf):
    return cleaning.drop_null(_gaps(spark, sf), ["v"])


@query("SELECT 'orders' AS stream, count(*) AS n, count(o_orderkey) AS orders, count(l_orderkey) AS lines FROM (SELECT o_orderkey, NULL AS l_orderkey FROM orders) q UNION ALL SELECT 'lines', count(*), 0, count(l_orderkey) FROM lineitem")
def tagged_union(spark, sf):
    u = cleaning.tagged_union({"orders": table(spark, sf, "orders").select("o_orderkey"), "lines": table(spark, sf, "lineitem").select("l_orderkey")})
    return u.groupBy(F.col("_stream").alias("stream")).agg(F.count("*").alias("n"), F.count("o_orderkey").alias("orders"), F.count("l_orderkey").alias("lines"))
