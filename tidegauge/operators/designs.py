"""Study designs over units: switchback, logged policies, factor absorption, quantiles, multiplicity, logistic weighting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.distributions import binom_sf, norm_ppf
from ..functions.effects import arms_side_by_side

# --- switchback -------------------------------------------------------------------------------------------------------


def switchback_periods(steps: DataFrame, washout: int = 0) -> DataFrame:
    """(unit_id, cycle, period, order, value): steps of a period summed, the first ``washout`` steps left out."""
    return steps.filter(F.col("step") >= washout).groupBy("unit_id", "cycle", "period", "order").agg(F.sum("value").alias("value"))


def switchback_contributions(periods: DataFrame, p: float = 0.5) -> DataFrame:
    """Per (unit, cycle) with both periods: (second - first)/(2p) for order CT, (first - second)/(2(1-p)) for TC."""
    first, second = (F.sum(F.when(F.col("period") == k, F.col("value"))) for k in (0, 1))
    both = periods.groupBy("unit_id", "cycle", "order").agg(first.alias("first"), second.alias("second")).filter("first IS NOT NULL AND second IS NOT NULL")
    d = F.col("second") - F.col("first")
    return both.select("unit_id", "cycle", "order", F.when(F.col("order") == "CT", d / (2 * p)).otherwise(-d / (2 * (1 - p))).alias("contribution"))


def switchback_effect(contributions: DataFrame) -> DataFrame:
    """Cycles are averaged within a unit, units give the mean, its error and n - 1 degrees of freedom."""
    units = contributions.groupBy("unit_id").agg(F.avg("contribution").alias("c"))
    return units.agg(F.count("*").alias("n_units"), F.avg("c").alias("effect"), (F.stddev_samp("c") / F.sqrt(F.count("*"))).alias("se"), (F.count("*") - 1).alias("df"))


# --- logged policies --------------------------------------------------------------------------------------------------


def policy_weights(trace: DataFrame, policy: DataFrame, name: str) -> DataFrame:
    """``trace`` (unit_id, t, context, action, propensity, reward) with log_w, the cumulative log ratio of a tabular policy
    (context, action, probability: a broadcast table of the policy's cells)."""
    p = policy.select("context", "action", F.col("probability").alias("_p"))
    step = F.log(F.coalesce("_p", F.lit(0.0))) - F.log("propensity")
    line = Window.partitionBy("unit_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    joined = trace.join(F.broadcast(p), ["context", "action"], "left")
    return joined.withColumn("step", F.when(F.col("_p") > 0, step)).select("unit_id", "t", "reward", F.when(F.count_if(F.col("step").isNull()).over(line) == 0, F.sum("step").over(line)).alias("log_w"), F.lit(name).alias("policy"))


def policy_values(weighted: DataFrame) -> DataFrame:
    """Per decision: the self-normalised value and the effective sample size; weights are scaled by their largest."""
    top = weighted.groupBy("policy", "t").agg(F.max("log_w").alias("top"))
    w = F.coalesce(F.exp(F.col("log_w") - F.col("top")), F.lit(0.0))
    scaled = weighted.join(F.broadcast(top), ["policy", "t"]).withColumn("w", w)  # a row per decision time
    return scaled.groupBy("policy", "t").agg((F.sum(F.col("w") * F.col("reward")) / F.sum("w")).alias("value"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.max("top").alias("top"), F.sum("w").alias("total"))


def policy_contrast(trace: DataFrame, target: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean over decisions of the difference of two policies' values, with the sandwich error over units."""
    both = policy_weights(trace, target, "target").unionByName(policy_weights(trace, reference, "reference"))
    values = policy_values(both)
    u = F.coalesce(F.exp(F.col("log_w") - F.col("top")), F.lit(0.0)) / F.col("total")
    sign = F.when(F.col("policy") == "target", 1.0).otherwise(-1.0)
    psi = both.join(F.broadcast(values), ["policy", "t"]).withColumn("psi", sign * u * (F.col("reward") - F.col("value")))
    horizon = values.agg(F.max("t").alias("a"), F.min("t").alias("b"), F.count_distinct("t").alias("h"), (F.sum(sign * F.col("value")) / F.count_distinct("t")).alias("contrast"), F.min("ess").alias("min_ess"))
    units = psi.groupBy("unit_id").agg(F.sum("psi").alias("psi"))
    n = F.count("*")
    return units.crossJoin(F.broadcast(horizon)).groupBy("contrast", "min_ess").agg(n.alias("n_units"), F.sqrt(n / (n - 1) * F.sum(F.pow(F.col("psi") / F.col("h"), 2))).alias("se"))  # one row


# --- factors ----------------------------------------------------------------------------------------------------------


def factor_summary(totals: DataFrame, factor: str) -> DataFrame:
    """Level by arm: n, mean, centred sum of squares."""
    return totals.filter("y IS NOT NULL").groupBy(factor, "group_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), (F.count("*") * F.var_pop("y")).alias("ss"))


def absorbed_effect(levels: DataFrame, factor: str, control: str) -> DataFrame:
    """Hard pooling: the within-level difference, weighted by n_t n_c / (n_t + n_c), with a level-clustered error."""
    part = lambda on, c: F.max(F.when(on, F.col(c)))
    on, off = F.col("group_id") != control, F.col("group_id") == control
    pair = levels.groupBy(F.col(factor).alias("f")).agg(part(on, "n").alias("nt"), part(on, "mean").alias("mt"), part(off, "n").alias("nc"), part(off, "mean").alias("mc")).filter("nt >= 2 AND nc >= 2")
    pair = pair.withColumn("w", F.col("nt") * F.col("nc") / (F.col("nt") + F.col("nc"))).withColumn("d", F.col("mt") - F.col("mc"))
    est = pair.agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("effect"), F.sum("w").alias("total"), F.count("*").alias("levels"))
    both = pair.crossJoin(F.broadcast(est))  # one row
    k = F.max("levels")
    return both.groupBy("effect", "levels").agg((F.sqrt(k / (k - 1) * F.sum(F.pow(F.col("w") * (F.col("d") - F.col("effect")), 2))) / F.max("total")).alias("se"))


def absorb_partial(rows: list[dict], control: str, factor: str) -> dict:
    """Partial pooling on the driver from level-by-arm rows: weights n s_b^2 / (s_e^2 + n s_b^2) by the method of moments."""
    cells: dict = {}
    for r in rows:
        cells.setdefault(r[factor], {})["c" if r["group_id"] == control else "t"] = r
    both = [(x["t"], x["c"]) for x in cells.values() if len(x) == 2 and min(x["t"]["n"], x["c"]["n"]) >= 2]
    if len(both) < 3:
        raise EngineError("absorption.too_few_levels", f"{len(both)} usable levels", levels=len(both))
    n = np.array([[t["n"], c["n"]] for t, c in both], float)
    mean = np.array([[t["mean"], c["mean"]] for t, c in both])
    within = sum(t["ss"] + c["ss"] for t, c in both) / (n.sum() - 2 * len(both))
    share = n[:, 0].sum() / n.sum()
    size = n.sum(axis=1)
    delta = (n.prod(axis=1) / size * (mean[:, 0] - mean[:, 1])).sum() / (n.prod(axis=1) / size).sum()
    level = ((n * (mean - np.array([delta, 0.0]))).sum(axis=1)) / size
    grand = (size * level).sum() / size.sum()
    between = (size * (level - grand) ** 2).sum()
    variance = max(0.0, (between - (len(both) - 1) * within) / (size.sum() - (size**2).sum() / size.sum()))
    pool = size * variance / (within + size * variance) if variance else np.zeros(len(both))
    # quasi-demeaning of the treatment within levels, then least squares with an intercept
    keep = 1 - np.sqrt(1 - pool)
    tilt = np.array([[1.0, 0.0]] * len(both))
    x = tilt - keep[:, None] * (n[:, :1] / size[:, None])
    one = np.ones_like(tilt) - keep[:, None]
    y = mean - keep[:, None] * ((n * mean).sum(axis=1) / size)[:, None]
    gram = np.array([[(n * one * one).sum(), (n * one * x).sum()], [(n * one * x).sum(), (n * x * x).sum()]])
    beta = np.linalg.solve(gram, np.array([(n * one * y).sum(), (n * x * y).sum()]))
    resid = y - beta[0] * one - beta[1] * x
    meat = np.zeros((2, 2))
    for g in range(len(both)):
        s = np.array([(n[g] * one[g] * resid[g]).sum(), (n[g] * x[g] * resid[g]).sum()])
        meat += np.outer(s, s)
    inverse = np.linalg.inv(gram)
    cov = inverse @ meat @ inverse * len(both) / (len(both) - 1)
    return {"effect": float(beta[1]), "se": math.sqrt(cov[1, 1]), "df": len(both) - 2, "pooling": pool.tolist(), "share": float(share)}


# --- quantiles --------------------------------------------------------------------------------------------------------


def bracket_ranks(n: int, q: float, alpha: float) -> tuple[int, int] | None:
    """Order statistics (from 1) between which the quantile lies with probability 1 - alpha; None if n is too small."""

    def lower(p: float) -> int:
        """The largest rank a with P(Bin(n, p) <= a - 1) <= alpha / 2."""
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if 1 - binom_sf(mid - 1, n, p) <= alpha / 2:
                lo = mid
            else:
                hi = mid - 1
        return lo

    a, b = lower(q), n - lower(1 - q) + 1
    return (a, b) if a >= 1 and b <= n and b > a else None


def quantile_arms(units: DataFrame, q: float, alpha: float = 0.05) -> DataFrame:
    """Per arm: n, the linear-interpolated quantile, the bracket's order statistics and the Woodruff log error.

    The ranks follow from the arms' counts (a row per arm); an order statistic is an exact percentile at (rank-1)/(n-1).
    """
    rows = units.filter("y IS NOT NULL")
    counts = {r["group_id"]: r["count"] for r in rows.groupBy("group_id").count().collect()}
    ranks = {g: bracket_ranks(n, q, alpha) for g, n in counts.items()}
    z = norm_ppf(1 - alpha / 2)
    out = None
    for g, n in sorted(counts.items()):
        own = rows.filter(F.col("group_id") == g)
        a, b = ranks[g] or (1, n)
        points = F.percentile("y", [q, (a - 1) / max(1, n - 1), (b - 1) / max(1, n - 1)])
        one = own.agg(F.lit(g).alias("group_id"), F.count("*").alias("n"), points.alias("p")).select("group_id", "n", F.col("p")[0].alias("point"), F.col("p")[1].alias("lower"), F.col("p")[2].alias("upper"))
        one = one.withColumn("log_se", F.when(F.lit(ranks[g] is not None) & (F.col("lower") > 0), (F.log("upper") - F.log("lower")) / 2 / z))
        out = one if out is None else out.unionByName(one)
    return out


def quantile_lift(units: DataFrame, q: float, control: str, alpha: float = 0.05) -> DataFrame:
    arms = quantile_arms(units, q, alpha)
    z = norm_ppf(1 - alpha / 2)
    t = arms_side_by_side(arms, control)
    se, log = F.sqrt(F.col("t_log_se") ** 2 + F.col("c_log_se") ** 2), F.log(F.col("t_point") / F.col("c_point"))
    return t.select("group_id", F.col("t_point").alias("point"), F.col("c_point").alias("point_control"), F.expm1(log).alias("lift"), se.alias("se"), F.expm1(log - z * se).alias("lb"), F.expm1(log + z * se).alias("ub"))


# --- multiplicity -----------------------------------------------------------------------------------------------------


def _step_up(rows: DataFrame, order: Column, passes, by: list[str]) -> DataFrame:
    line = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    everything = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = rows.withColumns({"_k": F.row_number().over(line), "_m": F.count("*").over(everything)})
    return ranked.withColumn("_cut", F.max(F.when(passes(F.col("_k"), F.col("_m")), F.col("_k"))).over(everything))


def benjamini_hochberg(rows: DataFrame, q: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """``rows`` (p) with rank and selected: every p up to the largest p_(k) <= k q / m (a family is a small table)."""
    cut = _step_up(rows, F.col("p"), lambda k, m: F.col("p") <= k * q / m, by or [])
    everything = Window.partitionBy(*(by or [F.lit(1)]))
    limit = F.max(F.when(F.col("_k") <= F.col("_cut"), F.col("p"))).over(everything)
    return cut.withColumn("selected", F.coalesce(F.col("p") <= limit, F.lit(False))).withColumnRenamed("_k", "rank").drop("_m", "_cut")


def e_benjamini_hochberg(rows: DataFrame, q: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """``rows`` (log_e) with selected: the largest k with log e_(k) >= -log(q k / m)."""
    cut = _step_up(rows, F.col("log_e").desc(), lambda k, m: F.col("log_e") >= -F.log(q * k / m), by or [])
    return cut.withColumn("selected", F.coalesce(F.col("_k") <= F.col("_cut"), F.lit(False))).withColumnRenamed("_k", "rank").drop("_m", "_cut")


def bonferroni(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    m = F.count("*").over(Window.partitionBy(*(by or [F.lit(1)])))
    return rows.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * m))


# --- observational ----------------------------------------------------------------------------------------------------


def fold(unit: Column, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(folds)).cast("int")


def _design(columns: list[str]) -> list[Column]:
    return [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]


def logistic(rows: DataFrame, columns: list[str], label: str = "d", weight: Column | None = None, ridge: float = 1e-6, steps: int = 25) -> np.ndarray:
    """Coefficients of a logistic regression by Newton steps: each step is one aggregation of (p+1)(p+4)/2 sums."""
    x = _design(columns)
    p = len(x)
    beta = np.zeros(p)
    for _ in range(steps):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        w = F.lit(1.0) if weight is None else weight
        sums = [F.sum(w * xi * (F.col(label) - mu)) for xi in x] + [F.sum(w * xi * xj * mu * (1 - mu)) for i, xi in enumerate(x) for xj in x[i:]]
        got = np.array([float(v or 0.0) for v in rows.agg(*sums).first()])
        curve = np.zeros((p, p))
        curve[np.triu_indices(p)] = got[p:]
        curve = curve + np.triu(curve, 1).T + ridge * np.eye(p)
        step = np.linalg.solve(curve, got[:p] - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def predicted(columns: list[str], beta: np.ndarray, link: bool = True) -> Column:
    eta = sum((F.lit(float(b)) * c for b, c in zip(beta, _design(columns), strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-eta)) if link else eta


def iptw(units: DataFrame, columns: list[str], clip: float = 0.0) -> DataFrame:
    """Hajek means over the cohort (y, d, covariates), their difference, its influence error and the arms' effective sizes."""
    e = F.greatest(F.least(predicted(columns, logistic(units, columns)), F.lit(1 - clip)), F.lit(clip))
    scored = units.withColumn("e", e).withColumn("w", F.when(F.col("d") == 1, 1 / F.col("e")).otherwise(1 / (1 - F.col("e"))))
    on, off = F.col("d") == 1, F.col("d") == 0
    part = lambda c, s: F.sum(F.when(s, c))
    means = scored.agg((part(F.col("w") * F.col("y"), on) / part(F.col("w"), on)).alias("m1"), (part(F.col("w") * F.col("y"), off) / part(F.col("w"), off)).alias("m0"), part(F.col("w"), on).alias("s1"), part(F.col("w"), off).alias("s0"))
    both = scored.crossJoin(F.broadcast(means))  # one row
    psi = F.when(on, F.col("w") * (F.col("y") - F.col("m1")) / F.col("s1")).otherwise(-F.col("w") * (F.col("y") - F.col("m0")) / F.col("s0"))
    ess = lambda s: part(F.col("w"), s) ** 2 / part(F.col("w") * F.col("w"), s)
    return both.groupBy("m1", "m0").agg(F.count("*").alias("n"), F.sqrt(F.sum(psi * psi)).alias("se"), ess(on).alias("ess_treated"), ess(off).alias("ess_control")).withColumn("ate", F.col("m1") - F.col("m0"))


def ridge_fit(rows: DataFrame, columns: list[str], ridge: float = 1e-8, where: Column | None = None, target: str = "y") -> np.ndarray:
    """Least squares by one aggregation of the Gram matrix; the intercept isn't penalised."""
    x = _design(columns)
    rows = rows if where is None else rows.filter(where)
    p = len(x)
    sums = [F.sum(xi * F.col(target)) for xi in x] + [F.sum(xi * xj) for i, xi in enumerate(x) for xj in x[i:]]
    got = np.array([float(v or 0.0) for v in rows.agg(*sums).first()])
    gram = np.zeros((p, p))
    gram[np.triu_indices(p)] = got[p:]
    gram = gram + np.triu(gram, 1).T
    penalty = ridge * np.eye(p)
    penalty[0, 0] = 0
    return np.linalg.solve(gram + penalty, got[:p])


def aipw(units: DataFrame, columns: list[str], folds: int = 5, clip: float = 0.01, key: str = "unit_id") -> DataFrame:
    """Cross-fitted doubly robust difference: propensity and per-arm outcome models of the other folds score each fold."""
    rows = units.withColumn("_fold", fold(F.col(key), folds))
    e = m1 = m0 = F.lit(None).cast("double")
    for k in range(folds):
        rest, own = F.col("_fold") != k, F.col("_fold") == k
        e = F.when(own, predicted(columns, logistic(rows.filter(rest), columns))).otherwise(e)
        m1 = F.when(own, predicted(columns, ridge_fit(rows, columns, where=rest & (F.col("d") == 1)), False)).otherwise(m1)
        m0 = F.when(own, predicted(columns, ridge_fit(rows, columns, where=rest & (F.col("d") == 0)), False)).otherwise(m0)
    e = F.greatest(F.least(e, F.lit(1 - clip)), F.lit(clip))
    s = rows.withColumns({"e": e, "m1": m1, "m0": m0})
    w1, w0 = F.col("d") / F.col("e"), (1 - F.col("d")) / (1 - F.col("e"))
    norm = s.agg(F.avg(w1).alias("a1"), F.avg(w0).alias("a0"))
    both = s.crossJoin(F.broadcast(norm))  # one row
    psi = F.col("m1") - F.col("m0") + w1 / F.col("a1") * (F.col("y") - F.col("m1")) - w0 / F.col("a0") * (F.col("y") - F.col("m0"))
    return both.agg(F.count("*").alias("n"), F.avg(psi).alias("ate"), (F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se"))


def dml(units: DataFrame, columns: list[str], folds: int = 5, key: str = "unit_id") -> DataFrame:
    """Partially linear: residuals of outcome on residuals of treatment, both cross-fitted."""
    rows = units.withColumn("_fold", fold(F.col(key), folds))
    e = m = F.lit(None).cast("double")
    for k in range(folds):
        rest, own = F.col("_fold") != k, F.col("_fold") == k
        e = F.when(own, predicted(columns, logistic(rows.filter(rest), columns))).otherwise(e)
        m = F.when(own, predicted(columns, ridge_fit(rows, columns, where=rest), False)).otherwise(m)
    s = rows.select((F.col("y") - m).alias("ry"), (F.col("d") - e).alias("rd"))
    one = s.agg((F.sum(F.col("ry") * F.col("rd")) / F.sum(F.col("rd") * F.col("rd"))).alias("theta"), F.sum(F.col("rd") * F.col("rd")).alias("j"))
    both = s.crossJoin(F.broadcast(one))  # one row
    return both.groupBy("theta").agg(F.count("*").alias("n"), (F.sqrt(F.sum(F.pow(F.col("rd") * (F.col("ry") - F.col("theta") * F.col("rd")), 2))) / F.max("j")).alias("se"))


def balance(units: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """Standardised mean differences of covariates between treated and control rows, weighted if asked."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    long = units.select("d", w.alias("w"), F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_c")).select("d", "w", "_c.*")
    part = lambda s, c: F.sum(F.when(F.col("d") == s, c))
    stats = long.groupBy("covariate").agg(*((part(s, F.col("w") * F.col("x")) / part(s, F.col("w"))).alias(f"m{s}") for s in (0, 1)), *(F.var_samp(F.when(F.col("d") == s, F.col("x"))).alias(f"v{s}") for s in (0, 1)))
    return stats.select("covariate", F.col("m1").alias("mean_treated"), F.col("m0").alias("mean_control"), ((F.col("m1") - F.col("m0")) / F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("smd"))
