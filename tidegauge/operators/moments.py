"""Centred moments: the mergeable state of every arm, segment, day or cluster, in one aggregation.

Per group: n, and of the outcome y, the x slot (a covariate, a cluster's size or its uptake total) and the denominator den:
references (means) and centred sums c2 = sum (v - ref)^2, cross sums, den's third; with a 0/1 uptake d: sum_d and the
masked sums around the overall reference.  Spark's mergeable variance and covariance give them in one pass without
cancelling; first centred sums are 0 by construction and kept for the merge law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ["n", "ref_y", "cy1", "cy2", "ref_x", "cx1", "cx2", "cxy", "ref_den", "cden1", "cden2", "cden3", "cyden", "cxden", "sum_d", "cyd", "cy2d", "cxd"]


def _d(c: Column) -> Column:
    return c.cast("double")


def moment_columns(x: bool = False, den: bool = False, d: bool = False) -> list[Column]:
    """Aggregates of the slots as doubles: a DECIMAL's mean has four more digits than the column, and a sum may overflow."""
    y, cx, cd, take = (_d(F.col(c)) for c in ("y", "x", "den", "d"))
    n = F.count(y)
    zero = F.sum(F.lit(0.0))
    out = [n.alias("n"), F.avg(y).alias("ref_y"), zero.alias("cy1"), (n * F.var_pop(y)).alias("cy2")]
    if x:
        out += [F.avg(cx).alias("ref_x"), zero.alias("cx1"), (n * F.var_pop(cx)).alias("cx2"), (n * F.covar_pop(cx, y)).alias("cxy")]
    if den:
        third = n * F.skewness(cd) * F.pow(F.var_pop(cd), 1.5)
        out += [F.avg(cd).alias("ref_den"), zero.alias("cden1"), (n * F.var_pop(cd)).alias("cden2"), F.when(F.var_pop(cd) > 0, third).otherwise(0.0).alias("cden3"), (n * F.covar_pop(y, cd)).alias("cyden")]
        if x:
            out.append((n * F.covar_pop(cx, cd)).alias("cxden"))
    if d:
        taken = F.when(take == 1, y)
        shift = F.avg(taken) - F.avg(y)
        out += [F.sum(take).alias("sum_d"), (n * F.covar_pop(take, y)).alias("cyd"), F.coalesce(F.count(taken) * (F.var_pop(taken) + shift * shift), F.lit(0.0)).alias("cy2d")]
        if x:
            out.append((n * F.covar_pop(take, cx)).alias("cxd"))
    return out


def group_summary(totals: DataFrame, keys: list[str] | None = None, *, binary: bool = False) -> DataFrame:
    """Moments of ``totals`` (y, and x, den, d where present) by ``keys`` (default: group_id); rows without y are left out."""
    keys = ["group_id"] if keys is None else keys
    has = set(totals.columns)
    extra = [F.count_if(F.col("y") == 1).alias("successes"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("nonbinary")] if binary else []
    return totals.filter(F.col("y").isNotNull()).groupBy(*keys).agg(*moment_columns("x" in has, "den" in has, "d" in has), *extra)


def cluster_summary(totals: DataFrame, cluster: str = "cluster_id", *, uptake: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Two stages: units to clusters (totals and sizes), clusters to arms (and ``keys``); the denominator and the x slot are the
    cluster's size, or with ``uptake`` x is its uptake total; x_role says which."""
    keys = keys or []
    x = F.sum(_d(F.col("d"))) if uptake else F.count("y").cast("double")
    clusters = totals.filter(F.col("y").isNotNull()).groupBy(*keys, "group_id", cluster).agg(F.sum(_d(F.col("y"))).alias("y"), F.count("y").cast("double").alias("den"), x.alias("x"))
    return group_summary(clusters, [*keys, "group_id"]).withColumn("x_role", F.lit("uptake_total" if uptake else "cluster_size"))


def merge(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser moments from finer ones by the shift law: c2 = sum (c2_i + n_i d_i e_i) around the common reference.

    The spread of the parts' references is a weighted covariance around the weighted mean, taken as sums of differences
    from the group's reference, which is joined back (a row per group).
    """
    has = set(moments.columns)
    variables = [v for v in ("y", "x", "den") if f"ref_{v}" in has]
    pairs = [("y", "y", "cy2"), ("x", "x", "cx2"), ("x", "y", "cxy"), ("den", "den", "cden2"), ("y", "den", "cyden"), ("x", "den", "cxden")]
    pairs = [p for p in pairs if p[2] in has]
    refs = moments.groupBy(*keys).agg(F.sum("n").alias("_n"), *((F.sum(F.col("n") * F.col(f"ref_{v}")) / F.sum("n")).alias(f"_ref_{v}") for v in variables))
    on = [moments[k].eqNullSafe(refs[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    joined = moments.join(refs.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_n", *(f"_ref_{v}" for v in variables)), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    shift = {v: F.col(f"ref_{v}") - F.col(f"_ref_{v}") for v in variables}
    sums = [F.sum(F.col(name) + F.col("n") * shift[a] * shift[b]).alias(name) for a, b, name in pairs]
    if "cden3" in has:
        s = shift["den"]
        sums.append(F.sum(F.col("cden3") + 3 * s * F.col("cden2") + F.col("n") * s * s * s).alias("cden3"))
    if "sum_d" in has:
        s = shift["y"]
        sums += [F.sum("sum_d").alias("sum_d"), F.sum(F.col("cyd") + F.col("sum_d") * s).alias("cyd"), F.sum(F.col("cy2d") + 2 * s * F.col("cyd") + F.col("sum_d") * s * s).alias("cy2d")]
        if "cxd" in has:
            sums.append(F.sum(F.col("cxd") + F.col("sum_d") * shift["x"]).alias("cxd"))
    if "successes" in has:
        sums.append(F.sum("successes").alias("successes"))
    zero = {"y": "cy1", "x": "cx1", "den": "cden1"}
    return joined.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.max(f"_ref_{v}").alias(f"ref_{v}") for v in variables), *(F.sum(F.lit(0.0)).alias(zero[v]) for v in variables), *sums)


def from_summaries(rows: DataFrame) -> DataFrame:
    """Moments of published summaries: (keys, n, mean, var) or (keys, n, successes)."""
    if "successes" in rows.columns:
        p = F.col("successes") / F.col("n")
        return rows.select("*", p.alias("ref_y"), F.lit(0.0).alias("cy1"), (F.col("n") * p * (1 - p)).alias("cy2"))
    return rows.withColumns({"ref_y": F.col("mean"), "cy1": F.lit(0.0), "cy2": (F.col("n") - 1) * F.col("var")}).drop("mean", "var")


def from_raw_sums(rows: DataFrame) -> DataFrame:
    """Moments of raw sums (keys, n, sum_y, sum_y2); a negative square sum is clamped at 0."""
    mean = F.col("sum_y") / F.col("n")
    square = F.greatest(F.col("sum_y2") - F.col("n") * mean * mean, F.lit(0.0))
    return rows.withColumns({"ref_y": mean, "cy1": F.lit(0.0), "cy2": square}).drop("sum_y", "sum_y2")


def police(moments: DataFrame) -> DataFrame:
    """``moments`` with ``fault``: a square sum below 0 or a cross sum beyond Cauchy-Schwarz, else null."""
    has = set(moments.columns)
    fault = F.lit(None).cast("string")
    slack = 1 + 1e-9
    for cross, a, b in (("cxy", "cx2", "cy2"), ("cyden", "cy2", "cden2"), ("cxden", "cx2", "cden2")):
        if cross in has:
            fault = F.when(F.col(cross) * F.col(cross) > F.col(a) * F.col(b) * slack + 1e-12, F.lit(f"moments.cauchy_schwarz.{cross}")).otherwise(fault)
    for square in ("cy2", "cx2", "cden2"):
        if square in has:
            fault = F.when(F.col(square) < 0, F.lit(f"moments.negative.{square}")).otherwise(fault)
    return moments.withColumn("fault", fault)
