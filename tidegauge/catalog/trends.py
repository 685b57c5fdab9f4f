"""Queries of calendar reports and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import norm_ppf
from ..operators import calendar as C
from ..operators import dims
from ..operators import outcomes as O
from .base import events_of, facts, query, rounded, table

_S, _E = "2024-01-04", "2024-01-28"
_EV = "WITH ev AS (SELECT user_id::VARCHAR AS unit_id, user_id, event_id, ts, event_type AS event, value, (props->>'$.k')::INT AS k FROM events)"


def _trunc(grain: str, week: str = "monday", c: str = "ds") -> str:
    return {"day": c, "week": f"date_trunc('week', {c})::DATE" if week == "monday" else f"(date_trunc('week', {c} + 1)::DATE - 1)", "month": f"date_trunc('month', {c})::DATE"}[grain]


def _last(grain: str) -> str:
    return {"day": "period", "week": "period + 6", "month": "last_day(period)"}[grain]


def _spine(grain: str, week: str = "monday") -> str:
    return f"""days AS (SELECT unnest(generate_series(DATE '{_S}', DATE '{_E}', INTERVAL 1 DAY))::DATE AS ds),
per AS (SELECT {_trunc(grain, week)} AS period, count(*) AS n_days FROM days GROUP BY 1), sp AS (SELECT period, ({_last(grain)})::DATE AS period_end, period >= DATE '{_S}' AND {_last(grain)} <= DATE '{_E}' AS period_complete, n_days FROM per)"""


def _values(grain: str, week: str = "monday", where: str = "event = 'purchase' AND value IS NOT NULL") -> str:
    return f"pe AS (SELECT *, {_trunc(grain, week, 'ts::DATE')} AS period FROM ev WHERE {where} AND ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}')"


def _unit_query(agg: str, grain: str, week: str, sql_y: str, zero: bool):
    def run(spark, sf):
        spine = C.periods(spark, _S, _E, grain, week)
        stats = O.unit_day_stats(events_of(spark, sf, "purchase"))
        values = C.unit_values(stats, spine, agg, _S, _E, grain, week)
        members = C.population(facts(spark, sf), spine, _S, _E, grain, week)
        out = C.interval(C.period_moments(values, members, spine, zero_fill=zero), norm_ppf(0.975), agg == "conversion")
        return rounded(out.select("period", "period_complete", "n", "value", "ci_lb", "ci_ub"))

    y = f"coalesce(v.y, 0)" if zero else "v.y"
    join = "LEFT JOIN" if zero else "JOIN"
    z = norm_ppf(0.975)
    ci = (f"(m + {z}*{z}/(2*n)) / (1 + {z}*{z}/n)", f"{z} * sqrt(m * (1 - m) / n + {z}*{z}/(4.0*n*n)) / (1 + {z}*{z}/n)") if agg == "conversion" else ("m", f"{z} * sqrt(vs / n)")
    query(f"""{_EV}, {_spine(grain, week)}, {_values(grain, week)},
d AS (SELECT unit_id, period, ts::DATE AS ds, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM pe GROUP BY ALL),
v AS (SELECT unit_id, d.period, {sql_y} AS y FROM d JOIN sp USING (period) GROUP BY unit_id, d.period, sp.n_days),
pop AS (SELECT DISTINCT unit_id, {_trunc(grain, week, 'ts::DATE')} AS period FROM ev WHERE ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}'),
j AS (SELECT pop.period, {y} AS y FROM pop {join} v ON v.unit_id = pop.unit_id AND v.period = pop.period), a AS (SELECT period, count(y) AS n, avg(y) AS m, var_samp(y) AS vs FROM j GROUP BY 1)
SELECT sp.period, period_complete, coalesce(n, 0) AS n, round(m, 6) AS value, round({ci[0]} - {ci[1]}, 6) AS ci_lb, round({ci[0]} + {ci[1]}, 6) AS ci_ub FROM sp LEFT JOIN a USING (period)""", f"trend_{agg}_{grain}" + ("_sunday" if week == "sunday" else ""))(run)


_unit_query("sum", "day", "monday", "sum(s)", True)
_unit_query("count", "week", "monday", "sum(n)::DOUBLE", True)
_unit_query("conversion", "week", "sunday", "1.0", True)
_unit_query("avg_event", "week", "monday", "sum(s) / sum(n)", False)
_unit_query("avg_calendar_day", "month", "monday", "sum(s) / sp.n_days", True)
_unit_query("min", "week", "monday", "min(lo)", False)
_unit_query("max", "month", "monday", "max(hi)", False)
_unit_query("count_distinct", "week", "monday", "count(DISTINCT s)::DOUBLE", True)


@query(f"WITH x AS (SELECT 1), {_spine('week')} SELECT * FROM sp")
def calendar_periods(spark, sf):
    return C.periods(spark, _S, _E, "week").select("period", "period_end", "period_complete", "n_days")


@query("SELECT least((SELECT max(ts)::DATE FROM events WHERE event_type = 'purchase'), (SELECT max(ts)::DATE FROM events WHERE event_type = 'click')) AS end_edge")
def report_horizon(spark, sf):
    f = facts(spark, sf)
    return C.horizon([(f, "purchase"), (f, "click")])


@query(f"""{_EV}, {_spine('week')}, a AS (SELECT unit_id, {_trunc('week', c='ts::DATE')} AS period, sum(value) AS y FROM ev WHERE event = 'purchase' AND value IS NOT NULL AND ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}' GROUP BY ALL),
b AS (SELECT unit_id, {_trunc('week', c='ts::DATE')} AS period, count(*)::DOUBLE AS y FROM ev WHERE event = 'click' AND ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}' GROUP BY ALL),
pop AS (SELECT DISTINCT unit_id, {_trunc('week', c='ts::DATE')} AS period FROM ev WHERE ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}'),
q AS (SELECT pop.period, count(*) AS n, sum(coalesce(a.y, 0)) / nullif(sum(coalesce(b.y, 0)), 0) AS value FROM pop LEFT JOIN a USING (unit_id, period) LEFT JOIN b USING (unit_id, period) GROUP BY 1)
SELECT sp.period, period_complete, coalesce(n, 0) AS n, round(value, 6) AS value FROM sp LEFT JOIN q USING (period)""")
def trend_ratio_week(spark, sf):
    spine = C.periods(spark, _S, _E, "week")
    top = C.unit_values(O.unit_day_stats(events_of(spark, sf, "purchase")), spine, "sum", _S, _E, "week")
    bottom = C.unit_values(O.unit_day_stats(events_of(spark, sf, "click", None)), spine, "count", _S, _E, "week")
    return rounded(C.ratio_values(top, bottom, C.population(facts(spark, sf), spine, _S, _E, "week"), spine))


@query(f"""{_EV}, {_spine('week')}, {_values('week')}, pop AS (SELECT unit_id, period FROM (SELECT DISTINCT c_custkey::VARCHAR AS unit_id FROM customer) u, sp), v AS (SELECT unit_id, period, sum(value) AS y FROM pe GROUP BY ALL),
a AS (SELECT pop.period, count(*) AS n, avg(coalesce(y, 0)) AS m, count(*) * var_pop(coalesce(y, 0)) AS c FROM pop LEFT JOIN v USING (unit_id, period) GROUP BY 1) SELECT sp.period, period_complete, coalesce(n, 0) AS n, round(m, 6) AS ref_y, round(c / n, 4) AS var FROM sp LEFT JOIN a USING (period)""")
def trend_static_population(spark, sf):
    spine = C.periods(spark, _S, _E, "week")
    values = C.unit_values(O.unit_day_stats(events_of(spark, sf, "purchase")), spine, "sum", _S, _E, "week")
    given = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"))
    m = C.period_moments(values, C.population(facts(spark, sf), spine, _S, _E, "week", given=given), spine, zero_fill=True)
    return m.select("period", "period_complete", "n", F.round("ref_y", 6).alias("ref_y"), F.round(F.col("cy2") / F.col("n"), 4).alias("var"))


def _total(agg: str, sql: str, grain: str, fill: bool):
    def run(spark, sf):
        return rounded(C.total_values(events_of(spark, sf, "purchase"), C.periods(spark, _S, _E, grain), agg, _S, _E, grain))

    value = f"coalesce({sql}, 0)" if fill else sql
    query(f"{_EV}, {_spine(grain)}, {_values(grain)} SELECT sp.period, period_complete, round(({value})::DOUBLE, 6) AS value FROM sp LEFT JOIN pe USING (period) GROUP BY sp.period, period_complete, n_days", f"total_{agg}_{grain}")(run)


_total("sum", "sum(value)", "day", True)
_total("count", "count(value)", "week", True)
_total("count_distinct", "count(DISTINCT value)", "week", True)
_total("avg_event", "avg(value)", "month", False)
_total("avg_calendar_day", "sum(value) / n_days", "week", True)
_total("min", "min(value)", "day", False)
_total("max", "max(value)", "day", False)


@query(f"{_EV}, {_spine('week')}, pe AS (SELECT *, {_trunc('week', c='ts::DATE')} AS period FROM ev WHERE ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}') SELECT period, period_complete, event, round(sum(value), 6) AS value FROM pe JOIN sp USING (period) GROUP BY ALL")
def total_by_dimension(spark, sf):
    return rounded(C.total_values(facts(spark, sf), C.periods(spark, _S, _E, "week"), "sum", _S, _E, "week", by=("event",)))


@query(f"{_EV}, {_spine('day')}, {_values('day', where='true')} SELECT sp.period, period_complete, count(DISTINCT unit_id) AS value FROM sp LEFT JOIN pe USING (period) GROUP BY ALL")
def active_units_day(spark, sf):
    return C.active_values(facts(spark, sf), C.periods(spark, _S, _E, "day"), _S, _E, "day")


@query(f"{_EV}, {_spine('week')}, pe AS (SELECT *, {_trunc('week', c='ts::DATE')} AS period FROM ev WHERE ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}') SELECT period, period_complete, event, count(DISTINCT unit_id) AS value FROM pe JOIN sp USING (period) GROUP BY ALL")
def active_units_by_dimension(spark, sf):
    return C.active_values(facts(spark, sf), C.periods(spark, _S, _E, "week"), _S, _E, "week", by=("event",))


@query(f"{_EV}, {_spine('day')} SELECT sp.period, period_complete, count(DISTINCT unit_id) AS value FROM sp LEFT JOIN ev ON ev.event = 'purchase' AND ev.value IS NOT NULL AND ts::DATE BETWEEN period_end - 6 AND period_end AND ts::DATE <= DATE '{_E}' GROUP BY ALL")
def rolling_active_7d(spark, sf):
    return C.rolling_active_values(events_of(spark, sf, "purchase"), C.periods(spark, _S, _E, "day"), 7, _S, _E)


def _rolling(agg: str, sql: str, grain: str, window: int):
    def run(spark, sf):
        return rounded(C.rolling_total_values(events_of(spark, sf, "purchase"), C.periods(spark, _S, _E, grain), agg, window, _S, _E, grain))

    query(f"{_EV}, {_spine(grain)} SELECT sp.period, period_complete, round(({sql})::DOUBLE, 6) AS value FROM sp LEFT JOIN ev ON ev.event = 'purchase' AND ev.value IS NOT NULL AND ts::DATE BETWEEN period_end - {window - 1} AND period_end AND ts::DATE <= DATE '{_E}' AND ts::DATE >= DATE '{_S}' - {window - 1} GROUP BY ALL", f"rolling_{agg}_{window}d_{grain}")(run)


_rolling("sum", "coalesce(sum(value), 0)", "day", 7)
_rolling("avg_event", "avg(value)", "week", 14)
_rolling("count_distinct", "count(DISTINCT value)", "day", 3)
_rolling("max", "max(value)", "week", 28)


@query(f"""{_EV}, {_spine('week')}, o AS (SELECT unit_id, ts, k FROM ev WHERE k IS NOT NULL), r AS (SELECT unit_id, period, max(struct_pack(t := ts, k := k)).k AS k FROM o JOIN sp ON ts::DATE <= period_end GROUP BY ALL) SELECT * FROM r""")
def asof_property(spark, sf):
    return C.asof_property(facts(spark, sf).filter("k IS NOT NULL"), C.periods(spark, _S, _E, "week"), "k")


@query(f"""{_EV}, {_spine('week')}, {_values('week')}, o AS (SELECT unit_id, ts, k % 3 AS k FROM ev WHERE k IS NOT NULL), r AS (SELECT unit_id, period, max(struct_pack(t := ts, k := k)).k AS k FROM o JOIN sp ON ts::DATE <= period_end GROUP BY ALL),
v AS (SELECT unit_id, period, sum(value) AS y FROM pe GROUP BY ALL), pop AS (SELECT DISTINCT unit_id, {_trunc('week', c='ts::DATE')} AS period FROM ev WHERE ts::DATE BETWEEN DATE '{_S}' AND DATE '{_E}'),
a AS (SELECT pop.period, coalesce(r.k::VARCHAR, '<missing>') AS k, count(*) AS n, avg(coalesce(y, 0)) AS m FROM pop LEFT JOIN v USING (unit_id, period) LEFT JOIN r USING (unit_id, period) GROUP BY ALL) SELECT sp.period, period_complete, k, coalesce(n, 0) AS n, round(m, 6) AS ref_y FROM sp LEFT JOIN a USING (period)""")
def trend_by_asof_dimension(spark, sf):
    spine = C.periods(spark, _S, _E, "week")
    values = C.unit_values(O.unit_day_stats(events_of(spark, sf, "purchase")), spine, "sum", _S, _E, "week")
    by = C.asof_property(facts(spark, sf).filter("k IS NOT NULL").withColumn("k", F.col("k") % 3), spine, "k")
    m = C.period_moments(values, C.population(facts(spark, sf), spine, _S, _E, "week"), spine, zero_fill=True, by=by)
    return rounded(m.select("period", "period_complete", "k", "n", "ref_y"))


@query("SELECT user_id::VARCHAR AS unit_id, (ts + INTERVAL 330 MINUTE)::DATE AS ds, count(*) AS n_events FROM events GROUP BY ALL")
def day_boundary_offset(spark, sf):
    return O.unit_day_stats(facts(spark, sf), 330).select("unit_id", "ds", "n_events")


@query("SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def dim_plain(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    dims.check(nation, "c_nationkey", "plain")
    j = dims.join_plain(table(spark, sf, "customer"), nation, "c_nationkey")
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_LOG = "lg AS (SELECT o_custkey AS cust, o_orderdate AS changed_at, max(o_orderstatus) AS status FROM orders GROUP BY ALL), rg AS (SELECT *, lead(changed_at) OVER (PARTITION BY cust ORDER BY changed_at) AS nxt FROM lg)"


def _log(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("timestamp").alias("changed_at")).agg(F.max("o_orderstatus").alias("status"))


def _lines(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cust"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_quantity")


@query("WITH " + _LOG + " SELECT cust, changed_at AS valid_from, nxt AS valid_to, status FROM rg")
def changelog_ranges(spark, sf):
    return dims.changelog_ranges(_log(spark, sf), "cust").select("cust", "valid_from", "valid_to", "status")


@query("WITH " + _LOG + ", f AS (SELECT o_custkey AS cust, l_shipdate AS ts, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM f LEFT JOIN rg ON rg.cust = f.cust AND f.ts >= rg.changed_at AND f.ts < coalesce(rg.nxt, TIMESTAMP '9999-12-31') GROUP BY 1")
def dim_changelog_join(spark, sf):
    j = dims.join_changelog(_lines(spark, sf), _log(spark, sf), "cust")
    return j.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("WITH " + _LOG + ", f AS (SELECT o_custkey AS cust, l_shipdate AS ts, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS (SELECT cust, changed_at AS a, CASE WHEN cust % 2 = 0 THEN nxt END AS b, status FROM rg WHERE cust % 2 = 0 OR nxt IS NULL) SELECT status, count(*) AS n FROM f LEFT JOIN r ON r.cust = f.cust AND f.ts >= a AND f.ts < coalesce(b, TIMESTAMP '9999-12-31') GROUP BY 1")
def dim_range_join(spark, sf):
    r = dims.changelog_ranges(_log(spark, sf), "cust").filter("cust % 2 = 0 OR valid_to IS NULL").withColumn("valid_to", F.when(F.col("cust") % 2 == 0, F.col("valid_to")))
    return dims.join_ranges(_lines(spark, sf), r, "cust").groupBy("status").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT o_custkey AS cust, o_orderdate AS a, o_orderdate + INTERVAL 90 DAY AS b, o_orderkey FROM orders), w AS (SELECT *, max(b) OVER (PARTITION BY cust ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r) SELECT cust, count(*) AS n FROM w WHERE m > a GROUP BY 1")
def dim_overlap_check(spark, sf):
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 90 DAY")).alias("valid_to"))
    return dims.overlaps(r, "cust").groupBy("cust").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def dim_duplicate_check(spark, sf):
    return dims.duplicates(table(spark, sf, "customer"), "c_nationkey").select("c_nationkey", F.col("count").alias("n"))
