"""Small hand-computed experiments: exposures, windows, censoring, covariates, clusters, uptake."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.errors import EngineError
from tidegauge.operators import cleaning, dims
from tidegauge.operators import exposures as X
from tidegauge.operators import moments as M
from tidegauge.operators import outcomes as O


def ts(day, hour=0, minute=0):
    return dt.datetime(2025, 8, day, hour, minute)


@pytest.fixture(scope="module")
def log(spark):
    rows = [("u1", ts(1, 9), "treatment"), ("u1", ts(2, 9), "treatment"), ("u2", ts(1, 10), "control"), ("u3", ts(2, 11), "treatment"), ("u4", ts(3, 9), "treatment"), ("u4", ts(3, 10), "control")]
    return spark.createDataFrame([(u, t, "exp", g) for u, t, g in rows], "unit_id string, ts timestamp, experiment_id string, group_id string")


@pytest.fixture(scope="module")
def purchases(spark):
    rows = [("u1", ts(1, 9, 5), 49.99), ("u1", ts(1, 9, 10), 12.0), ("u1", ts(3, 14), 7.5), ("u2", ts(1, 9, 30), 25.0), ("u2", ts(2, 8), 30.0), ("u3", ts(3, 14, 40), 19.99)]
    return spark.createDataFrame(rows, "unit_id string, ts timestamp, value double")


def values(df, *cols):
    return {r.unit_id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_first_exposures_drop_mixed_units(log):
    got = values(X.first_exposures(log, "exp"), "group_id", "first_exposure_ts")
    assert got == {"u1": ("treatment", ts(1, 9)), "u2": ("control", ts(1, 10)), "u3": ("treatment", ts(2, 11))}
    with pytest.raises(EngineError, match="mixed_assignment"):
        X.first_exposures(log, "exp", mixed="error").collect()
    assert len(values(X.first_exposures(log, "exp", mixed="keep"), "group_id")) == 4


def test_unmatched_experiment_is_refused(log):
    with pytest.raises(EngineError) as e:
        X.first_exposures(log, "other")
    assert e.value.context["keys"] == ["exp"]


def test_windows(log, purchases):
    e = X.first_exposures(log, "exp")
    s = O.post_exposure_stats(purchases, e)
    assert values(O.unit_totals(e, s, O.Outcome("conversion", window=1)), "y") == {"u1": 1, "u2": 0, "u3": 0}
    total = values(O.unit_totals(e, s, O.Outcome("mean", "sum", 3)), "y")
    assert total == pytest.approx({"u1": 69.49, "u2": 30.0, "u3": 19.99})
    assert values(O.unit_totals(e, s, O.Outcome("retention", band=(2, 4))), "y") == {"u1": 1, "u2": 0, "u3": 0}
    assert values(O.unit_totals(e, s, O.Outcome("mean", "avg_event", 1)), "y") == {"u1": pytest.approx(30.995), "u2": None, "u3": None}


def test_censoring(spark):
    e = spark.createDataFrame([("exp", "u5", "treatment", ts(3, 12), dt.date(2025, 8, 3))], "experiment_id string, unit_id string, group_id string, first_exposure_ts timestamp, first_exposure_date date")
    kept = lambda o: O.censor(e, o, "2025-08-03").count()
    assert kept(O.Outcome("conversion", window=1)) == 1
    assert kept(O.Outcome("conversion", window=2)) == 0
    assert kept(O.Outcome("retention", band=(2, None))) == 0


def test_event_at_exposure_is_in_neither_period(spark):
    e = spark.createDataFrame([("exp", "u", "control", ts(3, 10), dt.date(2025, 8, 3))], "experiment_id string, unit_id string, group_id string, first_exposure_ts timestamp, first_exposure_date date")
    p = spark.createDataFrame([("u", ts(3, 10), 5.0), ("u", ts(3, 9), 1.0), ("u", ts(3, 11), 2.0), ("u", ts(1, 11), 4.0)], "unit_id string, ts timestamp, value double")
    assert values(O.pre_period_stats(p, e, 1), "x") == {"u": 1.0}
    assert values(O.pre_period_stats(p, e, 3), "x") == {"u": 5.0}
    assert values(O.unit_totals(e, O.post_exposure_stats(p, e), O.Outcome("mean", "sum", 1)), "y") == {"u": 2.0}


def test_cluster_collapse(spark):
    rows = [("u1", "control", "s1", 10.0), ("u2", "control", "s1", 20.0), ("u3", "control", "s2", 30.0), ("u4", "treatment", "s3", 40.0), ("u5", "treatment", "s3", 50.0), ("u6", "treatment", "s4", 0.0)]
    t = spark.createDataFrame(rows, "unit_id string, group_id string, cluster_id string, y double")
    got = {r.group_id: r for r in M.cluster_summary(t).collect()}
    c, r = got["control"], got["treatment"]
    assert (c.n, c.ref_y, c.cy2, c.ref_den, c.cden2, c.cyden) == pytest.approx((2, 30, 0, 1.5, 0.5, 0))
    assert (r.n, r.ref_y, r.cy2, r.ref_den, r.cden2, r.cyden, r.cxy) == pytest.approx((2, 45, 4050, 1.5, 0.5, 45, 45))
    d = t.withColumn("d", F.col("unit_id").isin("u1", "u4", "u5").cast("double"))
    u = {r.group_id: r for r in M.cluster_summary(d, uptake=True).collect()}
    assert (u["control"].ref_x, u["control"].cx2, u["control"].cxy, u["control"].cxden) == pytest.approx((0.5, 0.5, 0, 0.5))
    assert (u["treatment"].ref_x, u["treatment"].cx2, u["treatment"].cxy, u["treatment"].cxden) == pytest.approx((1, 2, 90, 1))


def test_masked_moments(spark):
    rows = [("treat", y, d) for y, d in ((10.0, 1), (20.0, 0), (30.0, 0))] + [("control", y, 0) for y in (1.0, 2.0, 3.0)]
    got = {r.group_id: r for r in M.group_summary(spark.createDataFrame(rows, "group_id string, y double, d int")).collect()}
    assert (got["treat"].ref_y, got["treat"].sum_d, got["treat"].cyd, got["treat"].cy2d) == pytest.approx((20, 1, -10, 100))
    assert (got["control"].sum_d, got["control"].cyd, got["control"].cy2d) == pytest.approx((0, 0, 0))


def test_merging_is_the_same_as_one_pass(spark):
    rows = spark.range(500).selectExpr("cast(id % 2 as string) as group_id", "id % 7 as part", "1e6 + pmod(id * 37, 101) as y", "pmod(id * 11, 13) + 1.0 as den", "pmod(id * 5, 17) * 1.0 as x", "cast(id % 3 = 0 as double) as d")
    one = {r.group_id: r.asDict() for r in M.group_summary(rows).collect()}
    two = {r.group_id: r.asDict() for r in M.merge(M.group_summary(rows, ["group_id", "part"]), ["group_id"]).collect()}
    for g, r in one.items():
        for k, v in two[g].items():
            assert v == r[k] if isinstance(v, str) else v == pytest.approx(r[k], rel=1e-7, abs=1e-4), k


def test_policing(spark):
    bad = spark.createDataFrame([("a", 3, -1.0, 1.0, 0.5), ("b", 3, 1.0, 1.0, 5.0), ("c", 3, 1.0, 1.0, 0.5)], "g string, n int, cy2 double, cx2 double, cxy double")
    assert {r.g: r.fault for r in M.police(bad).collect()} == {"a": "moments.negative.cy2", "b": "moments.cauchy_schwarz.cxy", "c": None}


def test_triggers(spark, log):
    e = X.first_exposures(log, "exp")
    t = spark.createDataFrame([("u1", ts(1, 8)), ("u1", ts(1, 9)), ("u2", ts(2)), ("u3", ts(9)), (None, ts(2)), ("zz", ts(2))], "unit_id string, ts timestamp")
    got = values(X.triggered_population(e, t, "2025-08-05"), "first_trigger_ts")
    assert got == {"u1": ts(1, 9), "u2": ts(2)}


def test_null_values_policy(spark):
    f = spark.createDataFrame([("u", ts(1), "buy", None), ("u", ts(1), "buy", 2.0)], "unit_id string, ts timestamp, event string, amount double")
    with pytest.raises(EngineError, match="fact_null_values"):
        O.metric_events(f, "buy", "amount")
    assert O.metric_events(f, "buy", "amount", missing="skip").count() == 1
    assert sorted(r.value for r in O.metric_events(f, "buy", "amount", missing="zero").collect()) == [0, 2]


def test_dimension_checks(spark):
    with pytest.raises(EngineError, match="duplicate"):
        dims.check(spark.createDataFrame([("a", 1), ("a", 2)], "e string, p int"), "e", "plain")
    r = spark.createDataFrame([("a", ts(1), ts(5)), ("a", ts(4), None)], "e string, valid_from timestamp, valid_to timestamp")
    with pytest.raises(EngineError, match="overlapping"):
        dims.check(r, "e", "ranges")
    facts = spark.createDataFrame([("a", ts(2), 1), ("a", ts(9), 2), ("b", ts(2), 3)], "e string, ts timestamp, n int")
    good = spark.createDataFrame([("a", ts(1), ts(5), "x"), ("a", ts(5), None, "y")], "e string, valid_from timestamp, valid_to timestamp, p string")
    assert {r.n: r.p for r in dims.join_ranges(facts, good, "e").collect()} == {1: "x", 2: "y", 3: None}
    with pytest.raises(EngineError, match="collision"):
        dims.join_plain(facts, spark.createDataFrame([("a", 1)], "e string, n int"), "e")


def test_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan")), ("b", 3.0)], "group_id string, y double")
    assert [r.y for r in cleaning.pooled_mean(df, ["y"]).collect()] == [1, 2, 2, 3]
    assert [r.y for r in cleaning.zeros(df, ["y"]).collect()] == [1, 0, 0, 3]
    assert cleaning.drop_null(df, ["y"]).count() == 2
    with pytest.raises(EngineError):
        cleaning.apply_missing(df, "y", "error")


def test_decimal_columns_have_the_moments_of_doubles(spark):
    from tidegauge.operators import moments as M

    rows = spark.range(300).selectExpr("'a' as group_id", "id % 5 as part", "cast(id % 13 as decimal(10,2)) as y", "cast(id % 7 as decimal(8,1)) as x", "cast(id % 11 + 1 as decimal(38,10)) as den", "cast(id % 2 as decimal(1,0)) as d")
    plain = rows.selectExpr("group_id", "part", *(f"cast({c} as double) as {c}" for c in ("y", "x", "den", "d")))
    for keys in (["group_id"], ["group_id", "part"]):
        a, b = (M.group_summary(r, keys).orderBy(*keys).collect() for r in (rows, plain))
        assert a == b


def test_asof_moments_of_a_large_mean(spark):
    """Against a dense panel: 1e9 or 1e9 + 1 on one day of each unit, and units without events."""
    import numpy as np

    from tidegauge.operators import outcomes as O

    n = 400
    exposures = spark.range(n).selectExpr("cast(id as string) as unit_id", "if(id % 2 = 0, 'c', 't') as group_id", "date_add(date'2024-01-01', cast(id % 3 as int)) as first_exposure_date")
    stats = spark.range(n).filter("id % 5 <> 4").selectExpr("cast(id as string) as unit_id", "if(id % 2 = 0, 'c', 't') as group_id", "date_add(date'2024-01-01', cast(id % 3 + id % 4 as int)) as ds", "cast(id % 4 as int) as day_offset", "1L as n_events", "1e9 + cast(id % 2 as double) + cast(id % 7 as double) as sum_value", "0D as min_value", "0D as max_value")
    got = {(str(r.ds), r.group_id): r for r in O.asof_moments(exposures, stats, "2024-01-08").collect()}
    for day in range(8):
        for arm, g in ((0, "c"), (1, "t")):
            y = np.array([(1e9 + i % 2 + i % 7) if i % 5 != 4 and i % 3 + i % 4 <= day else 0.0 for i in range(arm, n, 2) if i % 3 <= day], np.longdouble)
            r = got[f"2024-01-{day + 1:02d}", g]
            want = float(((y - y.mean()) ** 2).sum())
            assert r.n == len(y) and r.ref_y == pytest.approx(float(y.mean())) and r.cy2 == pytest.approx(want, rel=1e-9)
    late = stats.filter("unit_id % 5 <> 4").join(exposures.select("unit_id").filter("unit_id % 5 <> 4"), "unit_id", "left_semi")
    everyone = O.asof_moments(exposures.filter("unit_id % 5 <> 4"), late, "2024-01-20").filter("ds = date'2024-01-20' and group_id = 't'").first()
    y = np.array([1e9 + 1 + i % 7 for i in range(1, n, 2) if i % 5 != 4])
    assert everyone.cy2 == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-6)
