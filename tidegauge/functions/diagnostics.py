"""Health of an experiment: sample ratio, missing outcomes, allocation over time, confounding sensitivity."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distributions as dist


def sample_ratio_columns(counts: DataFrame, expected: dict[str, float]) -> DataFrame:
    """One row: n, Pearson's chi-square, degrees of freedom and the Dirichlet-mixture log e-value, from a row per arm."""
    total = sum(expected.values())
    share = F.lit(None).cast("double")
    for g, w in expected.items():
        share = F.when(F.col("group_id") == g, w / total).otherwise(share)
    rows = counts.withColumn("p", share).filter("p IS NOT NULL")
    sums = rows.agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "p")).alias("arms"))
    k = len(expected)
    # lgamma through the driver's rows would do as well; a row per arm keeps it a column
    chi2 = F.aggregate("arms", F.lit(0.0), lambda a, r: a + F.pow(r["n"] - F.col("n") * r["p"], 2) / (F.col("n") * r["p"]))
    got = sums.withColumn("chi2", chi2).first()
    log_e = math.lgamma(k) - math.lgamma(k + got.n) + sum(math.lgamma(r["n"] + 1) - r["n"] * math.log(r["p"]) for r in got.arms)
    return counts.sparkSession.createDataFrame([(int(got.n), float(got.chi2), k - 1, float(log_e))], "n long, chi2 double, df int, log_e double")


def sample_ratio(counts: dict[str, int], expected: dict[str, float], alpha: float = 0.001, inference: str = "anytime") -> dict:
    """Pearson's p-value, the log e-value, and whether the ratio is refused by the chosen evidence."""
    if set(counts) - set(expected):
        raise ValueError(f"arms without an expected share: {sorted(set(counts) - set(expected))}")
    n, total = sum(counts.values()), sum(expected.values())
    chi2 = sum((counts.get(g, 0) - n * w / total) ** 2 / (n * w / total) for g, w in expected.items()) if n else 0.0
    k = len(expected)
    log_e = math.lgamma(k) - math.lgamma(k + n) + sum(math.lgamma(counts.get(g, 0) + 1) - counts.get(g, 0) * math.log(w / total) for g, w in expected.items())
    p = dist.chi2_sf(chi2, k - 1)
    return {"n": n, "chi2": chi2, "p_value": p, "log_e": log_e, "is_srm": log_e >= -math.log(alpha) if inference == "anytime" else p < alpha}


def missing_by_arm(present: dict[str, int], missing: dict[str, int]) -> float:
    """p-value of equal missing shares."""
    arms = sorted(present)
    total, gone = sum(present.values()) + sum(missing.values()), sum(missing.values())
    if not gone or gone == total:
        return 1.0
    chi2 = 0.0
    for a in arms:
        n = present[a] + missing.get(a, 0)
        for seen, share in ((missing.get(a, 0), gone / total), (present[a], 1 - gone / total)):
            chi2 += (seen - n * share) ** 2 / (n * share)
    return dist.chi2_sf(chi2, len(arms) - 1)


def allocation_bands(daily: list[tuple[int, int]], alpha: float = 0.05) -> list[tuple[float, float, float]]:
    """Beta posterior (uniform prior) of the treated share after each day: mean and equal-tailed bounds."""
    out, t, n = [], 0, 0
    for treated, total in daily:
        t, n = t + treated, n + total
        a, b = t + 1, n - t + 1
        out.append((a / (a + b), dist.beta_ppf(alpha / 2, a, b), dist.beta_ppf(1 - alpha / 2, a, b)))
    return out


def welch_p(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int) -> float:
    a, b = v1 / n1, v2 / n2
    if a + b == 0:
        return 1.0
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return 2 * dist.t_sf(abs(m1 - m2) / math.sqrt(a + b), df)


def hotelling(means: np.ndarray, cov: np.ndarray, n1: int, n2: int) -> tuple[float, float]:
    """(T squared, p) of a difference of mean vectors with a pooled covariance."""
    p = len(means)
    t2 = n1 * n2 / (n1 + n2) * float(means @ np.linalg.solve(cov, means))
    d2 = n1 + n2 - p - 1
    return t2, dist.f_sf(t2 * d2 / (p * (n1 + n2 - 2)), p, d2)


def e_value(risk_ratio: float) -> float:
    """Strength of confounding that would explain the ratio away."""
    r = max(risk_ratio, 1 / risk_ratio)
    return r + math.sqrt(r * (r - 1))


def confounding_sensitivity(estimate: float, bound_towards_null: float) -> dict:
    crosses = (estimate - 1) * (bound_towards_null - 1) <= 0
    return {"point": e_value(estimate), "bound": 1.0 if crosses else e_value(bound_towards_null)}


def effective_size(weights: np.ndarray) -> float:
    return float(weights.sum() ** 2 / (weights**2).sum())
