import pytest

from tidegauge.catalog.misc import demo_definitions
from tidegauge.errors import EngineError
from tidegauge.plans.definitions import admit_read_only_sql, load_definitions
from tidegauge.plans.experiment import from_definitions
from tidegauge.sources import assignment, frames, stores


def broken(section, change):
    d = demo_definitions()
    change(d[section][0])
    return d


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a UNION ALL SELECT 2;", "select 'drop table x' as \"update\"  -- delete"])
def test_admitted(sql):
    assert admit_read_only_sql(sql)


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) DELETE FROM b", "", "/* select */ CREATE TABLE a AS SELECT 1"])
def test_refused(sql):
    with pytest.raises(EngineError):
        admit_read_only_sql(sql)


def test_refusals():
    load_definitions(demo_definitions())
    for section, change in (
        ("metrics", lambda m: m.update(fact="nope")), ("metrics", lambda m: m.update(aggregation="avg")), ("metrics", lambda m: m.update(colour="red")), ("metrics", lambda m: m.update(entity="other")),
        ("experiments", lambda e: e.update(metrics=["nope"])), ("experiments", lambda e: e.update(exposure="nope")), ("exposures", lambda e: e.update(sql="SELECT 1")), ("fact_sources", lambda s: s.update(sql="DROP TABLE x")),
    ):
        with pytest.raises(EngineError):
            load_definitions(broken(section, change))
    twice = demo_definitions()
    twice["metrics"].append(dict(twice["metrics"][0]))
    with pytest.raises(EngineError, match="duplicate"):
        load_definitions(twice)


def test_yaml_folder(tmp_path):
    import yaml

    for k, v in demo_definitions().items():
        (tmp_path / f"{k}.yaml").write_text(yaml.safe_dump({k: v}))
    assert set(load_definitions(tmp_path).experiments) == {"demo"}


def test_reader(spark):
    from tidegauge.catalog.misc import demo_view

    demo_view(spark, "/root/testdata/sf0.001")
    r = from_definitions(spark, demo_definitions(), "demo")
    rows = r.run().collect()
    assert [x.metric for x in rows] == ["spend", "bought", "back", "spend_per_click"]
    assert all((x.lift is None) == (x.reason is not None) for x in rows)
    assert r.breakout("spend", ["tier", "k"]).count() >= 3
    assert r.daily("spend").count() and r.asof_lift("spend").count()
    assert set(r.srm()) == {"n", "chi2", "p_value", "log_e", "is_srm"}
    r.close()
    for name, code in (("back", "day_metric"), ("spend_per_click", "day_metric")):
        with pytest.raises(EngineError, match=code):
            r.daily(name)
    d = demo_definitions()
    d["experiments"][0]["cluster"] = "tier"
    d["metrics"][0]["n_pre_periods"] = 3
    clustered = from_definitions(spark, d, "demo")
    with pytest.raises(EngineError, match="day_cluster"):
        clustered.asof("spend")
    clustered.close()
    d["experiments"][0].pop("cluster")
    adjusted = from_definitions(spark, d, "demo")
    plain = {x.segment: x for x in r.breakout("spend", ["tier"]).collect()}
    rows = adjusted.breakout("spend", ["tier"]).collect()
    assert rows and any(x.se != plain[x.segment].se for x in rows)  # a covariate adjusts within each segment
    adjusted.close()


def test_winsorized_metric(spark):
    from tidegauge.catalog.misc import demo_view
    from tidegauge.operators import winsor

    demo_view(spark, "/root/testdata/sf0.001")
    d = demo_definitions()
    d["metrics"][0]["winsorize"] = {"upper_percentile": 0.9}
    r = from_definitions(spark, d, "demo")
    got, want = r.run(["spend"]).first(), winsor.winsorized_lift(r.totals("spend", clip=False), None, 0.9, "control").first()
    assert (got.lift, got.se, got.lb) == pytest.approx((want.lift, want.se, want.lb))
    r.close()


def test_trend_by_dimension_and_filter(spark):
    from tidegauge.catalog.misc import demo_view
    from tidegauge.plans.trends import MetricTrends

    demo_view(spark, "/root/testdata/sf0.001")
    d = demo_definitions()
    for m in d["metrics"]:
        if m["name"] in ("buyers", "revenue"):
            m["filters"] = [{"property": "tier", "op": "in", "values": ["0", "1"]}]
    trends = MetricTrends(spark, load_definitions(d), "unit_id")
    for name, agg in (("buyers", "count(DISTINCT unit_id)"), ("revenue", "sum(value)")):
        got = {(str(r.period), r.tier): r.value for r in trends.metric(name, "week", "2024-01-01", "2024-01-21", by="tier").collect()}
        want = spark.sql(f"SELECT cast(date_trunc('week', ts) as date) AS p, tier, {agg} AS v FROM demo_events WHERE event = 'purchase' AND tier IN ('0', '1') AND cast(ts as date) BETWEEN date'2024-01-01' AND date'2024-01-21' GROUP BY 1, 2").collect()
        assert got == {(str(r.p), r.tier): pytest.approx(r.v) for r in want} and got


def test_allocation_agrees(spark):
    from pyspark.sql import functions as F

    arms = {"a": 2500, "b": 2500, "c": 5000}
    rows = spark.createDataFrame([(f"unit-{i}é",) for i in range(300)], "u string").withColumn("arm", assignment.allocate(F.col("u"), "sält", arms)).collect()
    assert all(r.arm == assignment.allocate_one(r.u, "sält", arms) for r in rows)
    with pytest.raises(EngineError):
        assignment.allocate_one("u", "s", {"a": 1})


def test_frames(spark):
    df = spark.createDataFrame([(str(i), "control" if i < 4 else "treatment", float(i % 4 + 1 + (i >= 4)), i % 2 == 0) for i in range(8)], "u string, g string, revenue double, won boolean")
    e = frames.from_unit_summary(df, "u", "g", ["revenue", "won"], "control")
    assert e.kinds == {"revenue": "mean", "won": "conversion"}
    means = {r.group_id: r.ref_y for r in e.moments("revenue").collect()}
    assert means == {"control": 2.5, "treatment": 3.5}
    assert {r.metric: r.mean_control for r in e.run().collect()} == {"revenue": 2.5, "won": 0.5}
    with pytest.raises(EngineError, match="duplicate"):
        frames.from_unit_summary(df.union(df), "u", "g", ["revenue"], "control")


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("m", "t", 0.1)], "metric string, group_id string, lift double")
    s = stores.ResultsStore(spark, str(tmp_path / "r"))
    a, _ = s.save(rows, "e"), s.save(rows, "e")
    assert s.load("e", a).count() == 1 and s.history("e").count() == 2
    with pytest.raises(EngineError):
        s.save(rows, "e", a)
    s.log_decision("e", {"verdict": "ship"})
    assert s.decisions("e").count() == 1
    df = spark.range(100).selectExpr("id", "cast(id as string) as s", "if(id % 3 = 0, null, id * 0.5) as x")
    assert stores.relation_digest(df) == stores.relation_digest(df.repartition(7)) != stores.relation_digest(df.filter("id > 0"))


def test_artifacts(spark, tmp_path):
    from tidegauge.schemas import EXPOSURES

    e = spark.sql("SELECT 'e' AS experiment_id, 'u' AS unit_id, 'a' AS group_id, timestamp'2025-01-01' AS first_exposure_ts, date'2025-01-01' AS first_exposure_date")
    s = stores.ArtifactStore(spark, str(tmp_path / "a"))
    g = s.publish({"exposures": e}, {"exposures": EXPOSURES})
    assert s.open(g)["exposures"].count() == 1
    s.drop(g)
    with pytest.raises(EngineError):
        s.open(g)
    with pytest.raises(EngineError, match="primary_key"):
        s.publish({"exposures": e.union(e)}, {"exposures": EXPOSURES})
