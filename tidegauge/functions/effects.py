"""Arm contrasts as column expressions over moment rows: a row per arm in, a row per treated arm out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distributions import norm_ppf
from .scalar import stable_log_ratio

#: Largest combined log standard error, and the route's three constants.
MAX_LOG_SE = 0.5
GUARD_COUNT, DENSE_FLOOR, DENSE_SLOPE = 9, 412, 145


def arms_side_by_side(moments: DataFrame, control: str, keys: list[str] | None = None) -> DataFrame:
    """Every treated arm's row beside the control's: columns t_* and c_*, with ``keys`` (segments, days) equal.

    The arms of a key (a few rows) are gathered once, so what made the moments runs once: a self-join would run it twice,
    as the filters on the arm are pushed below the aggregation.
    """
    keys = keys or []
    values = [c for c in moments.columns if c not in ("group_id", *keys)]
    arms = moments.groupBy(*keys).agg(F.collect_list(F.struct("group_id", *values)).alias("_arms"))
    own = F.get(F.filter("_arms", lambda a: a["group_id"] == control), F.lit(0))
    others = F.explode(F.filter("_arms", lambda a: a["group_id"] != control))
    paired = arms.select(*keys, own.alias("_c"), others.alias("_t")).filter("_c IS NOT NULL")
    return paired.select(*keys, F.col("_t.group_id").alias("group_id"), *(F.col(f"_t.{v}").alias(f"t_{v}") for v in values), *(F.col(f"_c.{v}").alias(f"c_{v}") for v in values))


def variance(p: str, square: str = "cy2") -> Column:
    return F.try_divide(F.col(f"{p}_{square}"), F.col(f"{p}_n") - 1)


def relative_lift(moments: DataFrame, control: str, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """lift, se (of the log ratio), lb and ub; ``reason`` where it can't be had: a mean or an error at or below 0, or too wide."""
    z = norm_ppf(1 - alpha / 2)
    both = arms_side_by_side(moments, control, keys)
    se2 = lambda p: F.try_divide(variance(p), F.col(f"{p}_n") * F.col(f"{p}_ref_y") * F.col(f"{p}_ref_y"))
    se = F.sqrt(se2("t") + se2("c"))
    point = stable_log_ratio(F.col("t_ref_y"), F.col("c_ref_y"))
    reason = (
        F.when((F.col("t_n") < 2) | (F.col("c_n") < 2), "too_few_units").when((F.col("t_ref_y") <= 0) | (F.col("c_ref_y") <= 0), "mean_not_positive")
        .when((F.col("t_cy2") <= 0) | (F.col("c_cy2") <= 0), "no_variance").when(se >= MAX_LOG_SE, "too_wide"))
    return _log_scale(both.select(*(keys or []), "group_id", F.col("t_n").alias("n_treatment"), F.col("c_n").alias("n_control"), F.col("t_ref_y").alias("mean_treatment"), F.col("c_ref_y").alias("mean_control"), reason.alias("reason"), point.alias("_p"), se.alias("_s")), z)


def _log_scale(df: DataFrame, z: float) -> DataFrame:
    ok = F.col("reason").isNull()
    return df.select(*(c for c in df.columns if c not in ("_p", "_s")), F.when(ok, F.expm1("_p")).alias("lift"), F.when(ok, F.col("_s")).alias("se"), F.when(ok, F.expm1(F.col("_p") - z * F.col("_s"))).alias("lb"), F.when(ok, F.expm1(F.col("_p") + z * F.col("_s"))).alias("ub"))


def absolute_difference(moments: DataFrame, control: str, keys: list[str] | None = None) -> DataFrame:
    """diff, se and Welch-Satterthwaite degrees of freedom."""
    both = arms_side_by_side(moments, control, keys)
    a, b = variance("t") / F.col("t_n"), variance("c") / F.col("c_n")
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("t_n") - 1) + F.try_divide(b * b, F.col("c_n") - 1))
    return both.select(*(keys or []), "group_id", (F.col("t_ref_y") - F.col("c_ref_y")).alias("diff"), F.sqrt(a + b).alias("se"), df.alias("df"))


def _ratio_parts(p: str) -> tuple[Column, Column, Column]:
    """(ratio, variance of its log, variance of it) of one arm."""
    n, num, den = F.col(f"{p}_n"), F.nullif(F.col(f"{p}_ref_y"), F.lit(0.0)), F.nullif(F.col(f"{p}_ref_den"), F.lit(0.0))
    vn, vd, cov = (F.try_divide(F.col(f"{p}_{c}"), n - 1) for c in ("cy2", "cden2", "cyden"))
    r = num / den
    return r, (vn / (num * num) + vd / (den * den) - 2 * cov / (num * den)) / n, (vn - 2 * r * cov + r * r * vd) / (n * den * den)


def ratio_lift(moments: DataFrame, control: str, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Relative lift of a ratio of sums by the delta method, and the denominators' precision and skewness of their means."""
    z = norm_ppf(1 - alpha / 2)
    both = arms_side_by_side(moments, control, keys)
    (rt, vt, _), (rc, vc, _) = _ratio_parts("t"), _ratio_parts("c")
    precision = lambda p: F.try_divide(F.sqrt(F.try_divide(F.col(f"{p}_cden2"), F.col(f"{p}_n") - 1) / F.col(f"{p}_n")), F.col(f"{p}_ref_den"))
    reason = F.when((F.col("t_ref_den") <= 0) | (F.col("c_ref_den") <= 0), "denominator_not_positive").when((rt <= 0) | (rc <= 0), "ratio_not_positive").when(F.sqrt(vt + vc) >= MAX_LOG_SE, "too_wide")
    return _log_scale(both.select(*(keys or []), "group_id", rt.alias("ratio_treatment"), rc.alias("ratio_control"), F.greatest(precision("t"), precision("c")).alias("denominator_precision"), reason.alias("reason"), stable_log_ratio(rt, rc).alias("_p"), F.sqrt(vt + vc).alias("_s")), z)


def ratio_difference(moments: DataFrame, control: str, keys: list[str] | None = None) -> DataFrame:
    both = arms_side_by_side(moments, control, keys)
    (rt, _, vt), (rc, _, vc) = _ratio_parts("t"), _ratio_parts("c")
    return both.select(*(keys or []), "group_id", (rt - rc).alias("diff"), F.sqrt(vt + vc).alias("se"))


def cuped(moments: DataFrame, control: str, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Scalar CUPED of each pair: theta is sum of Cov(y, x)/n over sum of Var(x)/n of the arms whose x varies; means are adjusted to the
    pooled mean of x; the difference's error is of the residuals, the lift's takes the moving anchor into account."""
    z = norm_ppf(1 - alpha / 2)
    both = arms_side_by_side(moments, control, keys)
    v = lambda p, c: F.try_divide(F.col(f"{p}_{c}"), F.col(f"{p}_n") - 1)
    live = lambda p, c: F.when(F.col(f"{p}_cx2") > 0, v(p, c) / F.col(f"{p}_n")).otherwise(0.0)
    wt = F.col("t_n") / (F.col("t_n") + F.col("c_n"))
    wc = 1 - wt
    theta = (live("t", "cxy") + live("c", "cxy")) / F.nullif(live("t", "cx2") + live("c", "cx2"), F.lit(0.0))
    both = both.withColumns({"theta": theta, "anchor": wt * F.col("t_ref_x") + wc * F.col("c_ref_x")})
    theta = F.col("theta")
    adjusted = lambda p: F.col(f"{p}_ref_y") - theta * (F.col(f"{p}_ref_x") - F.col("anchor"))
    residual = lambda p, s: (v(p, "cy2") - 2 * s * v(p, "cxy") + s * s * v(p, "cx2")) / F.col(f"{p}_n")
    jt, jc = adjusted("t"), adjusted("c")
    # the log ratio moves with an arm's mean of x through its own adjustment and through the anchor of both
    se_log = F.sqrt(residual("t", theta * (wc + wt * jt / jc)) / (jt * jt) + residual("c", theta * (wt + wc * jc / jt)) / (jc * jc))
    log = stable_log_ratio(jt, jc)
    return both.select(*(keys or []), "group_id", "theta", jt.alias("mean_treatment"), jc.alias("mean_control"), (jt - jc).alias("diff"), F.sqrt(residual("t", theta) + residual("c", theta)).alias("diff_se"), F.expm1(log).alias("lift"), se_log.alias("se"), F.expm1(log - z * se_log).alias("lb"), F.expm1(log + z * se_log).alias("ub"))


def late(moments: DataFrame, control: str, keys: list[str] | None = None) -> DataFrame:
    """Intent to treat, first stage and their ratio with a delta-method error, from moments with a masked uptake."""
    both = arms_side_by_side(moments, control, keys)
    d = lambda p: F.col(f"{p}_sum_d") / F.col(f"{p}_n")
    var_d = lambda p: F.try_divide(d(p) * (1 - d(p)), F.col(f"{p}_n") - 1)
    cov = lambda p: F.try_divide(F.col(f"{p}_cyd"), F.col(f"{p}_n") - 1) / F.col(f"{p}_n")
    a, b = F.col("t_ref_y") - F.col("c_ref_y"), d("t") - d("c")
    va = variance("t") / F.col("t_n") + variance("c") / F.col("c_n")
    vb, cab = var_d("t") + var_d("c"), cov("t") + cov("c")
    tau = a / F.nullif(b, F.lit(0.0))
    return both.select(*(keys or []), "group_id", a.alias("itt"), F.sqrt(va).alias("itt_se"), b.alias("first_stage"), F.sqrt(vb).alias("first_stage_se"), tau.alias("late"), (F.sqrt(va - 2 * tau * cab + tau * tau * vb) / F.abs(F.nullif(b, F.lit(0.0)))).alias("late_se"))


def sitewide(moments: DataFrame, control: str, volume: DataFrame) -> DataFrame:
    """Impact on the whole site of a sum metric: volume has total (observed site total) and n_site (site units).

    Without treatment the site had V0 = V - delta n_T; all treated, it gains I = delta N, relative to V0.
    """
    both = arms_side_by_side(moments, control).crossJoin(F.broadcast(volume))  # one row
    delta = F.col("t_ref_y") - F.col("c_ref_y")
    se = F.sqrt(variance("t") / F.col("t_n") + variance("c") / F.col("c_n"))
    base = F.col("total") - delta * F.col("t_n")
    return both.select("group_id", delta.alias("delta"), (delta * F.col("n_site")).alias("impact"), (delta * F.col("n_site") / base).alias("relative_impact"), (F.abs(F.col("n_site") * F.col("total") / (base * base)) * se).alias("relative_se"))


def sitewide_ratio(moments: DataFrame, control: str, volume: DataFrame) -> DataFrame:
    """Impact on a site-wide ratio: volume has num, den (observed site totals) and n_site; each arm's per-unit numerator and
    denominator effects are taken out of the site, then given to all of it: N1/D1 - N0/D0, with the delta-method error."""
    both = arms_side_by_side(moments, control).crossJoin(F.broadcast(volume))  # one row
    a, b = F.col("t_ref_y") - F.col("c_ref_y"), F.col("t_ref_den") - F.col("c_ref_den")
    n0, d0 = F.col("num") - a * F.col("t_n"), F.col("den") - b * F.col("t_n")
    n1, d1 = n0 + a * F.col("n_site"), d0 + b * F.col("n_site")
    var = lambda c: sum((F.try_divide(F.col(f"{p}_{c}"), F.col(f"{p}_n") - 1) / F.col(f"{p}_n") for p in ("t", "c")), F.lit(0.0))
    ga = (F.col("n_site") - F.col("t_n")) / d1 + F.col("t_n") / d0
    gb = -n1 * (F.col("n_site") - F.col("t_n")) / (d1 * d1) - n0 * F.col("t_n") / (d0 * d0)
    se = F.sqrt(ga * ga * var("cy2") + 2 * ga * gb * var("cyden") + gb * gb * var("cden2"))
    return both.select("group_id", (n0 / d0).alias("without"), (n1 / d1).alias("with_all"), (n1 / d1 - n0 / d0).alias("impact"), se.alias("se"))


def ratio_cuped(moments: DataFrame, control: str, alpha: float = 0.05) -> DataFrame:
    """Ratio of sums with numerator and denominator adjusted by their own slopes on one shared covariate."""
    z = norm_ppf(1 - alpha / 2)
    both = arms_side_by_side(moments, control)
    v = lambda p, c: F.try_divide(F.col(f"{p}_{c}"), F.col(f"{p}_n") - 1) / F.col(f"{p}_n")
    wt = F.col("t_n") / (F.col("t_n") + F.col("c_n"))
    both = both.withColumns({"_vx": v("t", "cx2") + v("c", "cx2"), "_cy": v("t", "cxy") + v("c", "cxy"), "_cd": v("t", "cxden") + v("c", "cxden"), "anchor": wt * F.col("t_ref_x") + (1 - wt) * F.col("c_ref_x")})
    both = both.withColumns({"theta_y": F.col("_cy") / F.nullif("_vx", F.lit(0.0)), "theta_den": F.col("_cd") / F.nullif("_vx", F.lit(0.0))})
    part = lambda p, ref, theta: F.col(f"{p}_{ref}") - F.col(theta) * (F.col(f"{p}_ref_x") - F.col("anchor"))
    mean = {p: (part(p, "ref_y", "theta_y"), part(p, "ref_den", "theta_den")) for p in "tc"}
    # the slope of each arm's log ratio on its mean of x, and through the anchor on the other arm's
    g = {p: F.col("theta_y") / mean[p][0] - F.col("theta_den") / mean[p][1] for p in "tc"}

    def square(p: str, slope: Column) -> Column:
        y, d = 1 / mean[p][0], -1 / mean[p][1]
        return y * y * v(p, "cy2") + d * d * v(p, "cden2") + slope * slope * v(p, "cx2") + 2 * y * d * v(p, "cyden") + 2 * y * slope * v(p, "cxy") + 2 * d * slope * v(p, "cxden")

    # in units of each arm: log ratio of t minus that of c
    st = -g["t"] * (1 - wt) - g["c"] * wt
    sc = -g["c"] * wt - g["t"] * (1 - wt)
    se = F.sqrt(square("t", st) + square("c", sc))
    log = stable_log_ratio(mean["t"][0] / mean["t"][1], mean["c"][0] / mean["c"][1])
    return both.select("group_id", (mean["t"][0] / mean["t"][1]).alias("ratio_treatment"), (mean["c"][0] / mean["c"][1]).alias("ratio_control"), F.expm1(log).alias("lift"), se.alias("se"), F.expm1(log - z * se).alias("lb"), F.expm1(log + z * se).alias("ub"))


def count_boundary(n: Column, alpha: float, rho: float, directional: bool = False) -> Column:
    """Anytime-valid squared-score boundary (1 + L/n)(log1p(n/L) - 2 log alpha), L = 1/rho^2."""
    import math

    lam = 1 / (rho * rho)
    a = 2 * alpha if directional else alpha
    return (1 + lam / n) * (F.log1p(n / lam) - 2 * math.log(a))


def asymptotic_sequence(asof: DataFrame, control: str, alpha: float = 0.05, rho: float = 0.1) -> DataFrame:
    """Per look (ds): the difference of means and its confidence sequence's half-width."""
    both = arms_side_by_side(asof, control, ["ds"])
    n = (F.col("t_n") + F.col("c_n")).alias("n")
    se = F.sqrt(variance("t") / F.col("t_n") + variance("c") / F.col("c_n"))
    out = both.select("ds", "group_id", n, (F.col("t_ref_y") - F.col("c_ref_y")).alias("diff"), se.alias("se"))
    half = F.col("se") * F.sqrt(count_boundary(F.col("n").cast("double"), alpha, rho))
    return out.select("ds", "group_id", "n", "diff", "se", half.alias("half_width"), (F.col("diff") - half).alias("lb"), (F.col("diff") + half).alias("ub"))
