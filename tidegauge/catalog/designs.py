"""Queries of study designs, segments, multiplicity, regression and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diagnostics as G
from ..functions import effects as E
from ..operators import designs as D
from ..operators import exposures as X
from ..operators import moments as M
from ..operators import regress as R
from ..operators import segments as S
from .base import BASE, EDGE, exposures, facts, query, rounded, table
from .pipeline import _TOT, _sums

_SW = """WITH st AS (SELECT user_id::VARCHAR AS unit_id, date_diff('day', DATE '2024-01-01', ts::DATE) // 2 AS cycle, date_diff('day', DATE '2024-01-01', ts::DATE) % 2 AS period,
  CASE WHEN (user_id + date_diff('day', DATE '2024-01-01', ts::DATE) // 2) % 2 = 0 THEN 'CT' ELSE 'TC' END AS ord, hour(ts) AS step, coalesce(value, 0) AS value FROM events),
pr AS (SELECT unit_id, cycle, period, ord, sum(value) AS v FROM st WHERE step >= 2 GROUP BY ALL),
ct AS (SELECT unit_id, cycle, ord, max(v) FILTER (period = 0) AS a, max(v) FILTER (period = 1) AS b FROM pr GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL),
c AS (SELECT unit_id, cycle, ord, CASE ord WHEN 'CT' THEN (b - a) / (2 * 0.5) ELSE (a - b) / (2 * (1 - 0.5)) END AS contribution FROM ct)"""


def _steps(spark, sf):
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    f = facts(spark, sf).withColumns({"cycle": F.floor(day / 2).cast("int"), "period": day % 2, "step": F.hour("ts"), "value": F.coalesce("value", F.lit(0.0))})
    return f.withColumn("order", F.when((F.col("user_id") + F.col("cycle")) % 2 == 0, "CT").otherwise("TC"))


@query(_SW + " SELECT unit_id, cycle::INT AS cycle, ord AS \"order\", round(contribution, 6) AS contribution FROM c")
def switchback_contributions(spark, sf):
    return rounded(D.switchback_contributions(D.switchback_periods(_steps(spark, sf), 2)))


@query(_SW + ", u AS (SELECT unit_id, avg(contribution) AS c FROM c GROUP BY 1) SELECT count(*) AS n_units, round(avg(c), 6) AS effect, round(stddev_samp(c) / sqrt(count(*)), 6) AS se, count(*) - 1 AS df FROM u")
def switchback_effect(spark, sf):
    return rounded(D.switchback_effect(D.switchback_contributions(D.switchback_periods(_steps(spark, sf), 2))))


_POL = """WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_type AS action, (user_id % 2) AS context, 0.2::DOUBLE AS propensity, coalesce(value, 0) AS reward FROM events),
tr AS (SELECT user_id || '-' || (i // 4) AS unit_id, i % 4 + 1 AS t, action, context, propensity, reward FROM o),
pol(policy, context, action, p) AS (SELECT 'target', c, a, CASE WHEN a = 'view' THEN 0.4 ELSE 0.15 END::DOUBLE FROM (SELECT unnest([0, 1]) AS c) q, (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error']) AS a) r
  UNION ALL SELECT 'reference', c, a, CASE WHEN a = 'click' AND c = 0 THEN 0.3 WHEN c = 0 THEN 0.175 ELSE 0.2 END::DOUBLE FROM (SELECT unnest([0, 1]) AS c) q, (SELECT unnest(['signup', 'view', 'click', 'purchase', 'error']) AS a) r),
w AS (SELECT policy, unit_id, t, reward, exp(sum(ln(p / propensity)) OVER (PARTITION BY policy, unit_id ORDER BY t)) AS w FROM tr JOIN pol USING (context, action)),
v AS (SELECT policy, t, sum(w * reward) / sum(w) AS value, sum(w) * sum(w) / sum(w * w) AS ess, sum(w) AS total FROM w GROUP BY ALL)"""


def _trace(spark, sf):
    from pyspark.sql import Window

    """Every event: a user's events in order, in trajectories of four decisions (the last may be shorter)."""
    f = facts(spark, sf)
    i = F.row_number().over(Window.partitionBy("unit_id").orderBy("event_id")) - 1
    numbered = f.withColumn("i", i)
    return numbered.select(F.concat_ws("-", "unit_id", F.floor(F.col("i") / 4)).alias("unit_id"), (F.col("i") % 4 + 1).alias("t"), F.col("event").alias("action"), (F.col("user_id") % 2).cast("int").alias("context"), F.lit(0.2).alias("propensity"), F.coalesce("value", F.lit(0.0)).alias("reward"))


def _policies(spark):
    actions = ["signup", "view", "click", "purchase", "error"]
    schema = "context int, action string, probability double"
    target = spark.createDataFrame([(c, a, 0.4 if a == "view" else 0.15) for c in (0, 1) for a in actions], schema)
    reference = spark.createDataFrame([(c, a, 0.2 if c else 0.3 if a == "click" else 0.175) for c in (0, 1) for a in actions], schema)
    return target, reference


@query(_POL + " SELECT policy, t::INT AS t, round(value, 6) AS value, round(ess, 4) AS ess FROM v")
def logged_policy_values(spark, sf):
    trace = _trace(spark, sf)
    target, reference = _policies(spark)
    both = D.policy_weights(trace, target, "target").unionByName(D.policy_weights(trace, reference, "reference"))
    return D.policy_values(both).select("policy", "t", F.round("value", 6).alias("value"), F.round("ess", 4).alias("ess"))


@query(_POL + """, h AS (SELECT count(DISTINCT t) AS h, sum(CASE policy WHEN 'target' THEN value ELSE -value END) / count(DISTINCT t) AS contrast, min(ess) AS min_ess FROM v),
u AS (SELECT unit_id, sum((CASE policy WHEN 'target' THEN 1 ELSE -1 END) * w / total * (reward - value)) AS psi FROM w JOIN v USING (policy, t) GROUP BY 1)
SELECT round(contrast, 6) AS contrast, round(min_ess, 4) AS min_ess, count(*) AS n_units, round(sqrt(count(*) / (count(*) - 1) * sum(pow(psi / h, 2))), 6) AS se FROM u, h GROUP BY contrast, min_ess""")
def logged_policy_contrast(spark, sf):
    r = D.policy_contrast(_trace(spark, sf), *_policies(spark))
    return r.select(F.round("contrast", 6).alias("contrast"), F.round("min_ess", 4).alias("min_ess"), "n_units", F.round("se", 6).alias("se"))


_LV = _TOT + ", fl AS (SELECT (unit_id::BIGINT % 6)::VARCHAR AS level, group_id, count(*) AS n, avg(y) AS mean, count(*) * var_pop(y) AS ss FROM t GROUP BY ALL)"


def _levels(spark, sf):
    return D.factor_summary(_sums(spark, sf).withColumn("level", (F.col("unit_id").cast("long") % 6).cast("string")), "level")


@query(_LV + " SELECT level, group_id, n, round(mean, 6) AS mean, round(ss, 4) AS ss FROM fl")
def factor_summaries(spark, sf):
    return _levels(spark, sf).select("level", "group_id", "n", F.round("mean", 6).alias("mean"), F.round("ss", 4).alias("ss"))


_UF = "WITH t AS (SELECT o_custkey::VARCHAR AS unit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_id, o_orderpriority AS level, o_totalprice / 1000 AS y, o_orderkey FROM orders)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("treatment").alias("group_id"), F.col("o_orderpriority").alias("level"), (F.col("o_totalprice") / 1000).alias("y"), "o_orderkey", "o_custkey")


@query(_UF + """, l AS (SELECT level, count(*) FILTER (group_id = 'treatment')::DOUBLE AS nt, avg(y) FILTER (group_id = 'treatment') AS mt, count(*) FILTER (group_id = 'control')::DOUBLE AS nc, avg(y) FILTER (group_id = 'control') AS mc FROM t GROUP BY 1),
w AS (SELECT nt * nc / (nt + nc) AS w, mt - mc AS d FROM l), e AS (SELECT sum(w * d) / sum(w) AS effect, sum(w) AS total, count(*) AS k FROM w)
SELECT round(effect, 6) AS effect, k AS levels, round(sqrt(k / (k - 1.0) * sum(pow(w * (d - effect), 2))) / total, 6) AS se FROM w, e GROUP BY effect, k, total""")
def absorbed_effect(spark, sf):
    return rounded(D.absorbed_effect(D.factor_summary(_orders(spark, sf), "level"), "level", "control"))


_SEG = _UF + """, m AS (SELECT level AS segment, group_id, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) AS v FROM t GROUP BY ALL),
e AS (SELECT a.segment, ln(a.m / b.m) AS est, a.v / (a.n * a.m * a.m) + b.v / (b.n * b.m * b.m) AS var FROM m a JOIN m b ON a.segment = b.segment AND a.group_id = 'treatment' AND b.group_id = 'control')"""


def _segment_effects(spark, sf):
    m = M.group_summary(_orders(spark, sf), ["level", "group_id"])
    lift = E.relative_lift(m, "control", keys=["level"])
    return lift.select(F.col("level").alias("segment"), F.log1p("lift").alias("est"), (F.col("se") * F.col("se")).alias("var"))


@query(_SEG + """, s AS (SELECT count(*) AS k, sum(1 / var) AS w, sum(1 / (var * var)) AS w2, sum(est / var) / sum(1 / var) AS mu FROM e), q AS (SELECT s.k, s.mu, sum((est - mu) * (est - mu) / var) AS q, w, w2 FROM e, s GROUP BY ALL)
SELECT k, round(mu, 6) AS mu, round(q, 4) AS q, k - 1 AS df, round(greatest(0, (q - (k - 1)) / (w - w2 / w)), 6) AS tau2, round(CASE WHEN k >= 5 THEN greatest(0, (q - (k - 1)) / q) END, 6) AS i2 FROM q""")
def segment_heterogeneity(spark, sf):
    return rounded(S.heterogeneity(_segment_effects(spark, sf))).withColumn("q", F.round("q", 4))


@query(_SEG + ", s AS (SELECT count(*) AS k, sum(1 / (var + 0.0001)) AS w, sum(est / (var + 0.0001)) / sum(1 / (var + 0.0001)) AS mu FROM e) SELECT k, round(mu, 6) AS mu, round(sqrt(sum(pow(est - mu, 2) / (var + 0.0001)) / ((k - 1) * w)), 6) AS se, k - 1 AS df FROM e, s GROUP BY k, mu, w")
def random_effects_mean(spark, sf):
    return rounded(S.random_effects(_segment_effects(spark, sf), 0.0001))


@query(_SEG + " SELECT a.segment AS a, b.segment AS b, round(a.est - b.est, 6) AS diff, round(sqrt(a.var + b.var), 6) AS se FROM e a JOIN e b ON a.segment < b.segment")
def segment_contrasts(spark, sf):
    return rounded(S.segment_contrasts(_segment_effects(spark, sf)))


_PV = "WITH p AS (SELECT o_orderpriority || o_orderstatus AS name, (count(*) % 97) / 1000.0::DOUBLE AS p FROM orders GROUP BY 1)"


def _pvalues(spark, sf):
    return table(spark, sf, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("name")).agg(((F.count("*") % 97) / 1000.0).alias("p"))


@query(_PV + ", r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p), c AS (SELECT max(p) FILTER (p <= k * 0.1 / m) AS t FROM r) SELECT name, round(p, 6) AS p, coalesce(p <= t, false) AS selected FROM r, c")
def benjamini_hochberg(spark, sf):
    return rounded(D.benjamini_hochberg(_pvalues(spark, sf), 0.1).drop("rank"))


@query(_PV + ", e AS (SELECT name, -ln(p + 0.0005) AS log_e FROM p), r AS (SELECT *, row_number() OVER (ORDER BY log_e DESC, name) AS k, count(*) OVER () AS m FROM e), c AS (SELECT coalesce(max(k) FILTER (log_e >= -ln(0.2 * k / m)), 0) AS t FROM r) SELECT count(*) AS n, count(*) FILTER (k <= t) AS selected FROM r, c")
def e_benjamini_hochberg(spark, sf):
    e = _pvalues(spark, sf).select("name", (-F.log(F.col("p") + 0.0005)).alias("log_e"))
    return D.e_benjamini_hochberg(e, 0.2).agg(F.count("*").alias("n"), F.count_if("selected").alias("selected"))


@query(_PV + " SELECT name, round(p, 6) AS p, round(least(1, p * count(*) OVER ()), 6) AS p_adjusted FROM p")
def bonferroni(spark, sf):
    return rounded(D.bonferroni(_pvalues(spark, sf)))


@query(BASE + """c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (group_id = 'control')::DOUBLE AS a, count(*) FILTER (group_id = 'treatment')::DOUBLE AS b FROM x)
SELECT n::BIGINT AS n, round(pow(a - n / 2, 2) / (n / 2) + pow(b - n / 2, 2) / (n / 2), 6) AS chi2, 1 AS df, round(lgamma(2) - lgamma(2 + n) + lgamma(a + 1) + a * ln(2) + lgamma(b + 1) + b * ln(2), 4) AS log_e FROM c""")
def sample_ratio(spark, sf):
    r = G.sample_ratio_columns(X.arm_counts(exposures(spark, sf)), {"control": 0.5, "treatment": 0.5})
    return r.select("n", F.round("chi2", 6).alias("chi2"), "df", F.round("log_e", 4).alias("log_e"))


@query(_UF + " SELECT group_id, count(*) AS n, round(quantile_cont(y, 0.9), 6) AS point FROM t GROUP BY 1")
def quantile_points(spark, sf):
    return rounded(D.quantile_arms(_orders(spark, sf), 0.9).select("group_id", "n", "point"))


@query(None)
def quantile_lift(spark, sf):
    return rounded(D.quantile_lift(_orders(spark, sf), 0.9, "control"))


_OBS = "WITH u AS (SELECT o_orderkey, (o_custkey % 3 = 0)::INT AS d, CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS x1, CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS x2, o_totalprice / 100000 AS y FROM orders)"


def _observed(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 3 == 0).cast("double").alias("d"), F.col("o_orderpriority").like("1%").cast("double").alias("x1"), F.col("o_orderpriority").like("2%").cast("double").alias("x2"), (F.col("o_totalprice") / 100000).alias("y"))


@query(_OBS + """, e AS (SELECT *, avg(d) OVER (PARTITION BY x1, x2) AS e FROM u), w AS (SELECT *, CASE WHEN d = 1 THEN 1 / e ELSE 1 / (1 - e) END AS w FROM e),
m AS (SELECT sum(w * y) FILTER (d = 1) / sum(w) FILTER (d = 1) AS m1, sum(w * y) FILTER (d = 0) / sum(w) FILTER (d = 0) AS m0, sum(w) FILTER (d = 1) AS s1, sum(w) FILTER (d = 0) AS s0 FROM w)
SELECT round(m1, 4) AS m1, round(m0, 4) AS m0, count(*) AS n, round(sqrt(sum(pow(CASE WHEN d = 1 THEN w * (y - m1) / s1 ELSE w * (y - m0) / s0 END, 2))), 4) AS se, round(m1 - m0, 4) AS ate FROM w, m GROUP BY m1, m0""")
def iptw_effect(spark, sf):
    return rounded(D.iptw(_observed(spark, sf), ["x1", "x2"]).drop("ess_treated", "ess_control"), 4)


@query(None)
def aipw_effect(spark, sf):
    return rounded(D.aipw(_observed(spark, sf), ["x1", "x2"]), 4)


@query(None)
def dml_effect(spark, sf):
    return rounded(D.dml(_observed(spark, sf), ["x1", "x2"]), 4)


@query(_OBS + ", l AS (SELECT d, 'x1' AS covariate, x1::DOUBLE AS x FROM u UNION ALL SELECT d, 'x2', x2::DOUBLE FROM u) SELECT covariate, round(avg(x) FILTER (d = 1), 6) AS mean_treated, round(avg(x) FILTER (d = 0), 6) AS mean_control, round((avg(x) FILTER (d = 1) - avg(x) FILTER (d = 0)) / sqrt((var_samp(x) FILTER (d = 1) + var_samp(x) FILTER (d = 0)) / 2), 6) AS smd FROM l GROUP BY 1")
def covariate_balance(spark, sf):
    return rounded(D.balance(_observed(spark, sf), ["x1", "x2"]))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(count(*) * covar_pop(l_quantity, l_discount) / count(*), 6) AS cov FROM lineitem GROUP BY 1")
def gram_matrix(spark, sf):
    g = R.gram(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_discount", ["l_returnflag"])
    return g.select("l_returnflag", "n", F.round("mean_l_quantity", 6).alias("mean_l_quantity"), F.round(F.col("s_l_quantity_l_discount") / F.col("n"), 6).alias("cov"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def least_squares_tsqr(spark, sf):
    b = R.least_squares(table(spark, sf, "lineitem"), [F.lit(1.0), F.col("l_quantity")], F.col("l_extendedprice"))
    return spark.createDataFrame([(round(float(b[1]), 4), round(float(b[0]), 2))], "slope double, intercept double")


_ADJ = "WITH u AS (SELECT (o_orderkey % 2 = 1)::INT AS d, o_custkey / 1000.0 AS x, o_totalprice / 1000 AS y FROM orders)"


@query(_ADJ + """, m AS (SELECT avg(x) AS mx FROM u), r AS (SELECT d, regr_slope(y, x - mx) AS b, regr_intercept(y, x - mx) AS a FROM u, m GROUP BY 1) SELECT round(max(a) FILTER (d = 1) - max(a) FILTER (d = 0), 4) AS effect, (SELECT count(*) FROM u) AS n FROM r""")
def interacted_adjustment(spark, sf):
    u = table(spark, sf, "orders").select((F.col("o_orderkey") % 2 == 1).alias("d"), (F.col("o_custkey") / 1000.0).alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    fit = R.interacted(u, ["x"], F.col("d"))
    return spark.createDataFrame([(round(fit["effect"], 4), fit["n"])], "effect double, n long")


@query(_UF + " SELECT group_id, level, count(*) AS n, round(avg(y), 6) AS mean, round(count(*) * var_pop(y) / count(*), 4) AS var FROM t GROUP BY ALL")
def categorical_cells(spark, sf):
    return R.cells(_orders(spark, sf), ["level"]).select("group_id", "level", "n", F.round("mean", 6).alias("mean"), F.round(F.col("ss") / F.col("n"), 4).alias("var"))


@query(_UF + """, g AS (SELECT level, count(*) FILTER (group_id = 'treatment')::DOUBLE AS nt, avg(y) FILTER (group_id = 'treatment') AS mt, var_samp(y) FILTER (group_id = 'treatment') AS vt, count(*) FILTER (group_id = 'control')::DOUBLE AS nc, avg(y) FILTER (group_id = 'control') AS mc, var_samp(y) FILTER (group_id = 'control') AS vc FROM t GROUP BY 1)
SELECT count(*) AS cells, sum(nt + nc)::BIGINT AS n, round(sum((nt + nc) * (mt - mc)) / sum(nt + nc), 6) AS effect, round(sqrt(sum(pow(nt + nc, 2) * (vt / nt + vc / nc))) / sum(nt + nc), 6) AS se FROM g""")
def post_stratified_effect(spark, sf):
    return rounded(R.post_stratified(R.cells(_orders(spark, sf), ["level"]), ["level"], "control"))


@query(_UF + ", s AS (SELECT *, (hash(1) * 0 + o_orderkey % 10)::DOUBLE AS score FROM t), b AS (SELECT *, CASE WHEN score <= 4 THEN 1 ELSE 2 END AS bin FROM s) SELECT bin::INT AS bin, count(*) FILTER (group_id = 'treatment') AS n_t, count(*) FILTER (group_id = 'control') AS n_c, round(avg(y) FILTER (group_id = 'treatment') - avg(y) FILTER (group_id = 'control'), 6) AS diff, round(sqrt(var_samp(y) FILTER (group_id = 'treatment') / count(*) FILTER (group_id = 'treatment') + var_samp(y) FILTER (group_id = 'control') / count(*) FILTER (group_id = 'control')), 6) AS se FROM b GROUP BY 1")
def targeting_bins(spark, sf):
    return rounded(S.bin_effects(_orders(spark, sf).withColumn("score", (F.col("o_orderkey") % 10).cast("double")), 2, "control"))


_CL = "WITH c AS (SELECT c_nationkey AS cluster_id, avg(c_acctbal) AS score, count(*)::DOUBLE AS cost FROM customer GROUP BY 1)"


@query(_CL + ", r AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, cluster_id) AS spent FROM c) SELECT cluster_id, round(score, 6) AS score, cost, spent FROM r WHERE spent <= (SELECT sum(cost) * 0.4 FROM c)")
def deployment_prefix(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster_id"), F.col("c_acctbal").alias("score"))
    total = c.count()
    return S.budget_prefix(S.pooled_scores(c), total * 0.4).withColumn("score", F.round("score", 6))


@query("SELECT o_orderstatus AS group_id, count(*) AS n, count(*) FILTER (o_orderkey % 9 = 0) AS missing FROM orders GROUP BY 1")
def missing_by_arm(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("group_id")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 9 == 0).alias("missing"))


@query(None)
def input_digest(spark, sf):
    return R.input_digest(table(spark, sf, "orders"))


@query("WITH d AS (SELECT d.lang AS segment, l.quality FROM documents d JOIN labels l USING (doc_id)) SELECT segment, count(*) AS n, sum(quality)::BIGINT AS successes, round(avg(quality), 6) AS rate FROM d GROUP BY 1")
def stratified_rate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return rounded(d.groupBy(F.col("lang").alias("segment")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("successes"), F.avg("quality").alias("rate")))
