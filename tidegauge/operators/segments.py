"""Segments: breakouts of several properties in one pass, heterogeneity, contrasts between segments, ranked targeting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dimension
from .moments import cluster_summary, moment_columns


def labelled(totals: DataFrame, properties: list[str]) -> DataFrame:
    """``totals`` with y, a row for each property: breakout and segment."""
    labels = F.explode(F.array(*(F.struct(F.lit(p).alias("breakout"), dimension(F.col(p)).alias("segment")) for p in properties)))
    return totals.filter(F.col("y").isNotNull()).select("*", labels.alias("_label")).select("*", "_label.*")


def breakouts(totals: DataFrame, properties: list[str], cluster: str | None = None) -> DataFrame:
    """(breakout, segment, group_id, moments): every property's segments, from one scan (grouping by unpivoted labels); with
    ``cluster`` units are collapsed to their clusters within each segment first."""
    has = set(totals.columns)
    rows = labelled(totals, properties)
    if cluster:
        return cluster_summary(rows, cluster, keys=["breakout", "segment"])
    return rows.groupBy("breakout", "segment", "group_id").agg(*moment_columns("x" in has, "den" in has, "d" in has))


def heterogeneity(effects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cochran's Q, DerSimonian-Laird tau squared, I squared (from 5 segments on), pooled mean; ``effects`` has est and var."""
    by = by or []
    w = 1 / F.col("var")
    sums = effects.filter("var > 0").groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), (F.sum(w * F.col("est")) / F.sum(w)).alias("mu"), F.var_pop("est").alias("_v"), F.collect_list(F.struct(w.alias("w"), F.col("est").alias("e"))).alias("rows"))
    q = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["w"] * (r["e"] - F.col("mu")) * (r["e"] - F.col("mu")))
    out = sums.withColumn("q", q).withColumn("df", F.col("k") - 1)
    tau2 = F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / (F.col("w") - F.col("w2") / F.col("w")))
    i2 = F.when(F.col("k") >= 5, F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0))
    return out.select(*by, "k", "mu", "q", "df", tau2.alias("tau2"), i2.alias("i2"))


def random_effects(effects: DataFrame, tau2: float) -> DataFrame:
    """Hartung-Knapp-Sidik-Jonkman: mean, standard error, degrees of freedom."""
    w = 1 / (F.col("var") + tau2)
    one = effects.agg(F.count("*").alias("k"), F.sum(w).alias("w"), (F.sum(w * F.col("est")) / F.sum(w)).alias("mu"))
    both = effects.crossJoin(F.broadcast(one.select("k", "mu", F.col("w").alias("total"))))  # one row
    return both.groupBy("k", "mu").agg(F.sqrt(F.sum(w * F.pow(F.col("est") - F.col("mu"), 2)) / ((F.col("k") - 1) * F.max("total"))).alias("se")).withColumn("df", F.col("k") - 1)


def segment_contrasts(effects: DataFrame, segment: str = "segment") -> DataFrame:
    """Differences of effects between segments, each pair once (segments of one breakout: a bounded table)."""
    a = effects.select(F.col(segment).alias("a"), F.col("est").alias("ea"), F.col("var").alias("va"))
    b = effects.select(F.col(segment).alias("b"), F.col("est").alias("eb"), F.col("var").alias("vb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (F.col("ea") - F.col("eb")).alias("diff"), F.sqrt(F.col("va") + F.col("vb")).alias("se"))


#: Accuracy of the sketch that brackets a cut point.
_SKETCH = 100_000


def cut_points(scored: DataFrame, bins: int) -> list:
    """The least scores that at least i/bins of the scored rows don't exceed, exactly (no global sort; NaN comes last).

    A sketch brackets each cut; the rows below the bracket are counted, and those in it by score: four hundred-thousandths of
    the rows a cut reach the driver at most, ties as one.  A bracket that misses its rank is widened, at last to all scores.
    """
    score, margin = F.col("score"), 2 / _SKETCH
    n, defined = scored.agg(F.count("score"), F.count_if(score.isNotNull() & ~F.isnan("score"))).first()
    ranks = [-(-i * n // bins) for i in range(1, bins)]
    sought = [r for r in ranks if 0 < r <= defined]
    undefined = [float("nan")] * sum(r > defined for r in ranks)
    scored = scored.filter(score.isNotNull() & ~F.isnan("score"))
    while sought:
        shares = [x for r in sought for x in (max(0.0, r / defined - margin), min(1.0, r / defined + margin))]
        ends = F.percentile_approx("score", shares, _SKETCH) if margin < 1 else F.array(*[F.min("score"), F.max("score")] * len(sought))
        ends = scored.agg(ends.alias("q")).first().q
        brackets = list(zip(ends[::2], ends[1::2], strict=True))
        inside = reduce(lambda x, y: x | y, (score.between(F.lit(a), F.lit(b)) for a, b in brackets))
        below = [F.count_if(score < F.lit(a)).alias(f"below_{k}") for k, (a, _) in enumerate(brackets)]
        rows = scored.groupBy(F.when(inside, score).alias("score")).agg(F.count("*").alias("rows"), *below).collect()
        values = sorted((r.score, r.rows) for r in rows if r.score is not None)
        cuts = []
        for k, ((a, b), rank) in enumerate(zip(brackets, sought, strict=True)):
            upto = sum(r[f"below_{k}"] for r in rows)
            for value, many in values:
                if upto < rank and a <= value <= b:
                    upto += many
                    if upto >= rank:
                        cuts.append(value)
        if len(cuts) == len(sought):
            return cuts + undefined
        margin *= 100
    return undefined


def score_bins(scored: DataFrame, bins: int) -> DataFrame:
    """Rows with ``bin``: by exact cut points of the score at equal shares; a row without a score is in the first."""
    cuts = cut_points(scored, bins)
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    return scored.withColumn("bin", above + 1)


def bin_effects(scored: DataFrame, bins: int, control: str) -> DataFrame:
    """Per bin of the score: the difference of means between treated and control, and its error."""
    g = score_bins(scored, bins).groupBy("bin").agg(*(f.alias(n) for p, on in (("t", F.col("group_id") != control), ("c", F.col("group_id") == control)) for n, f in (
        (f"n_{p}", F.count_if(on)), (f"m_{p}", F.avg(F.when(on, F.col("y")))), (f"v_{p}", F.var_samp(F.when(on, F.col("y")))))))
    return g.select("bin", "n_t", "n_c", (F.col("m_t") - F.col("m_c")).alias("diff"), F.sqrt(F.col("v_t") / F.col("n_t") + F.col("v_c") / F.col("n_c")).alias("se"))


def budget_prefix(scores: DataFrame, budget: float, key: str = "cluster_id") -> DataFrame:
    """The prefix by falling score whose running cost stays within the budget; the first breach ends it (clusters: one row
    each, so the ordered window runs over a small table)."""
    order = Window.orderBy(F.col("score").desc(), key).rowsBetween(Window.unboundedPreceding, 0)
    run = scores.withColumn("spent", F.sum("cost").over(order))
    return run.withColumn("breach", F.max((F.col("spent") > budget).cast("int")).over(order)).filter("breach = 0").drop("breach")


def pooled_scores(units: DataFrame, key: str = "cluster_id") -> DataFrame:
    return units.groupBy(key).agg(F.avg("score").alias("score"), F.count("*").cast("double").alias("cost"))


def linear_score(columns: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    out = F.lit(intercept)
    for c, w in zip(columns, weights, strict=True):
        out = out + F.col(c) * F.lit(w)
    return out
