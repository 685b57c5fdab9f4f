"""Inference for percentile-winsorized means: the cut points are estimated too, and their influence is part of the error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import norm_ppf


def winsorized_lift(totals: DataFrame, lower: float | None, upper: float | None, control: str, alpha: float = 0.05) -> DataFrame:
    """Relative lift of winsorized means with an influence-function error.

    A cut point c at pooled share q moves an arm's mean by the arm's share beyond it; c itself moves with a row by
    (q - 1{y <= c}) / f(c), f being the pooled density there, from the quantiles beside it.  Each row's influence on the log
    ratio is its own winsorized deviation in its arm plus what it does through the cut points; the error is its root sum of
    squares.
    """
    rows = totals.filter("y IS NOT NULL").select("group_id", "y")
    n = rows.count()
    h = 0.5 * n ** (-1 / 3)
    cuts = []
    for q in (lower, upper):
        if q is not None:
            cuts.append((q, min(h, q / 2, (1 - q) / 2)))
    shares = [x for q, w in cuts for x in (q, q - w, q + w)]
    found = rows.agg(F.percentile("y", shares).alias("p")).first()["p"] if shares else []
    points = {}
    for k, (q, w) in enumerate(cuts):
        c, a, b = found[3 * k : 3 * k + 3]
        points["lower" if lower is not None and k == 0 else "upper"] = (q, c, 2 * w / (b - a) if b > a else None)
    low, high = points.get("lower"), points.get("upper")
    y = F.col("y")
    clipped = F.least(y, F.lit(high[1])) if high else y
    clipped = F.greatest(clipped, F.lit(low[1])) if low else clipped
    rows = rows.withColumn("w", clipped)
    beyond = {"low": F.avg((y < low[1]).cast("double")) if low else F.avg(F.lit(0.0)), "high": F.avg((y > high[1]).cast("double")) if high else F.avg(F.lit(0.0))}
    arms = {r.group_id: r for r in rows.groupBy("group_id").agg(F.count("*").alias("n"), F.avg("w").alias("m"), *(c.alias(k) for k, c in beyond.items())).collect()}  # a row per arm
    z, c = norm_ppf(1 - alpha / 2), arms[control]
    out = None
    for g, t in sorted(arms.items()):
        if g == control:
            continue
        own = F.when(F.col("group_id") == g, (F.col("w") - t.m) / (t.n * t.m)).when(F.col("group_id") == control, -(F.col("w") - c.m) / (c.n * c.m)).otherwise(0.0)
        psi = own
        for side, cut in (("low", low), ("high", high)):
            if cut and cut[2]:
                slope = t[side] / t.m - c[side] / c.m
                psi = psi + F.lit(slope / n / cut[2]) * (F.lit(cut[0]) - (y <= cut[1]).cast("double"))
        one = rows.agg(F.sqrt(F.sum(psi * psi)).alias("se")).select(F.lit(g).alias("group_id"), F.lit(float(t.m)).alias("mean_treatment"), F.lit(float(c.m)).alias("mean_control"), "se")
        out = one if out is None else out.unionByName(one)
    log = F.log(F.col("mean_treatment") / F.col("mean_control"))
    return out.select("*", F.expm1(log).alias("lift"), F.expm1(log - z * F.col("se")).alias("lb"), F.expm1(log + z * F.col("se")).alias("ub"))
