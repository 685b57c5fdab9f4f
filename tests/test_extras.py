import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.errors import EngineError
from tidegauge.functions import families, formula, sequential
from tidegauge.operators import designs, moments, regress, segments, simulate, winsor
from tidegauge.plans import registry


def test_formula(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0)], "a double, b double")
    assert [r.v for r in df.select(formula.to_column("(a + 1) / b - 2 * -a").alias("v")).collect()] == [pytest.approx(7 / 3 + 12), None]
    for bad in ("a ** b", "f(a)", "a +", "__import__('os')"):
        with pytest.raises(EngineError):
            formula.to_sql(bad)


def test_registry():
    assert {"relative_lift", "aipw"} <= set(registry.load())
    with pytest.raises(EngineError):
        registry.estimate("nothing", None, "m")
    with pytest.raises(EngineError):
        registry.register("cuped", "moments")(lambda m: m)


def test_simulation_is_the_same_on_any_partitioning(spark):
    a = simulate.clustered_units(spark, 20, 5)
    b = simulate.clustered_units(spark, 20, 5).repartition(7)
    assert sorted(a.collect()) == sorted(b.collect())
    r = simulate.replicate(spark, 8, lambda seed: {"x": float(np.random.default_rng(seed).normal())}, "x double").collect()
    assert len({round(x.x, 9) for x in r}) == 8


def test_logged_policy_finds_the_best_action(spark):
    trace = simulate.logged_run(spark, 500, 3, ["a", "b"], best="a", gain=1.0)
    policy = lambda p: spark.createDataFrame([(c, x, q) for c in (0, 1) for x, q in (("a", p), ("b", 1 - p))], "context int, action string, probability double")
    r = designs.policy_contrast(trace, policy(0.8), policy(0.2)).first()
    assert r.contrast == pytest.approx(0.6, abs=5 * r.se) and r.n_units == 500
    never = designs.policy_values(designs.policy_weights(trace, policy(1.0), "p")).filter("t = 1").first()
    assert never.value == pytest.approx(1.0, abs=0.05)


def test_doubly_robust_removes_confounding(spark):
    rows = spark.range(6000).select(F.col("id").alias("unit_id"), simulate.normal(3, F.col("id")).alias("x"))
    rows = rows.withColumn("d", (simulate.uniform(4, F.col("unit_id")) < 1 / (1 + F.exp(-F.col("x")))).cast("double"))
    rows = rows.withColumn("y", 2 * F.col("x") + 1.0 * F.col("d") + simulate.normal(5, F.col("unit_id"))).cache()
    naive = rows.groupBy("d").agg(F.avg("y").alias("m")).collect()
    assert abs(max(r.m for r in naive) - min(r.m for r in naive) - 1) > 0.5
    for r in (designs.aipw(rows, ["x"]).first(), designs.dml(rows, ["x"]).select(F.col("theta").alias("ate"), "se").first(), designs.iptw(rows, ["x"]).first()):
        assert r.ate == pytest.approx(1, abs=5 * r.se)
    b = {r.covariate: r.smd for r in designs.balance(rows, ["x"]).collect()}
    assert abs(b["x"]) > 0.5


def test_regressions_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [1.0, -2.0] + rng.normal(size=400)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert regress.least_squares(rows.repartition(5), [F.lit(1.0), F.col("a"), F.col("b")], F.col("y")) == pytest.approx(want)
    fit = regress.solve_gram(regress.gram(rows, ["a", "b"]).first().asDict(), ["a", "b"])
    assert [fit["intercept"], fit["a"], fit["b"]] == pytest.approx(list(want))


def test_winsorized_error_is_near_the_plain_one_for_light_tails(spark):
    from tidegauge.functions.effects import relative_lift

    t = spark.range(4000).select((F.when(F.col("id") % 2 == 0, "control").otherwise("treatment")).alias("group_id"), (10 + simulate.normal(1, F.col("id"))).alias("y"))
    w, p = winsor.winsorized_lift(t, 0.01, 0.99, "control").first(), relative_lift(moments.group_summary(t), "control").first()
    assert w.se == pytest.approx(p.se, rel=0.1) and w.lift == pytest.approx(p.lift, abs=p.se)


def test_absorption_and_checkpoints(spark):
    rows = [{"f": str(k), "group_id": g, "n": 50, "mean": 10 + 3 * k + (1 if g == "t" else 0), "ss": 49.0} for k in range(6) for g in ("c", "t")]
    r = designs.absorb_partial(rows, "c", "f")
    assert r["effect"] == pytest.approx(1) and all(0 <= x <= 1 for x in r["pooling"])
    c = sequential.Checkpoints(0.05, 0.1)
    c.look("2025-01-01", 100, 0.1, 0.1)
    assert c.look("2025-01-02", 10_000, 0.1, 0.01)["decided"] == "better"
    with pytest.raises(EngineError):
        c.look("2025-01-02", 10_000, 0.1, 0.01)
    e = families.exploratory([{"p": 1e-6, "est": 1.0, "se": 0.1}, {"p": 0.9, "est": 0.0, "se": 1.0}, {"p": None}], 0.1)
    assert [x["selected"] for x in e] == [True, False, False] and e[0]["lb"] < 1 - 1.9 * 0.1


def test_bins_of_a_score_are_cut_exactly(spark):
    rows = spark.range(0, 300_000, 1, 1).withColumn("score", (F.col("id") % 10).cast("double"))
    assert {r.bin: r["count"] for r in segments.score_bins(rows, 2).groupBy("bin").count().collect()} == {1: 150_000, 2: 150_000}
    x = np.random.default_rng(1).lognormal(size=200_003).round(4)
    drawn = spark.createDataFrame([(float(v),) for v in x], "score double")
    assert segments.cut_points(drawn, 7) == [np.sort(x)[-(-i * len(x) // 7) - 1] for i in range(1, 7)]


def test_bins_of_few_missing_and_undefined_scores(spark):
    odd = spark.createDataFrame([(None,), (1.0,), (float("nan"),), (2.0,), (float("nan"),)], "score double")
    cuts = segments.cut_points(odd, 4)
    assert cuts[:2] == [1.0, 2.0] and np.isnan(cuts[2])
    assert sorted((str(r.score), r.bin) for r in segments.score_bins(odd, 4).collect()) == [("1.0", 1), ("2.0", 2), ("None", 1), ("nan", 3), ("nan", 3)]
    assert segments.cut_points(odd, 1) == segments.cut_points(odd.limit(0), 3) == [] and segments.score_bins(odd.limit(0), 3).count() == 0


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    monkeypatch.setattr(segments, "_SKETCH", 3)
    x = np.random.default_rng(2).permutation(5_000)
    assert segments.cut_points(spark.createDataFrame([(int(v),) for v in x], "score int"), 3) == [1666, 3333]
