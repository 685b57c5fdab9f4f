"""Queries of sources, stores, streaming, planning and the semantic layer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import power
from ..operators import moments as M
from ..plans.definitions import admit_read_only_sql
from ..plans.experiment import from_definitions
from ..plans.trends import MetricTrends
from ..sources import assignment, frames, stores
from ..streaming import stream
from .base import BASE, EDGE, START, exposures, facts, query, rounded, table
from .pipeline import _LIFT, _TOT, _sums


def scratch(spark) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, a local master gets one of its own and a cluster is refused."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.no_shared_folder", "spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="tidegauge-")
        spark.sparkContext.setCheckpointDir(there)
    return f"{there.rstrip('/')}/{uuid.uuid4().hex}"


#: Fixed values of the demonstration: declarations in the definition format.
def demo_definitions(source: str = "demo_events") -> dict:
    return {
        "fact_sources": [{
            "name": "log", "sql": f"SELECT * FROM {source}", "timestamp_column": "ts", "entities": ["unit_id"],
            "facts": [{"name": "purchase", "column": "value", "missing": "skip"}, {"name": "click"}, {"name": "view"}],
            "properties": [{"name": "tier", "column": "tier", "as_of": "static"}, {"name": "k", "column": "k", "as_of": "pre_exposure"}],
        }],
        "exposures": [{"name": "first_view", "fact": "view"}],
        "metrics": [
            {"type": "mean", "name": "spend", "entity": "unit_id", "fact": "purchase", "aggregation": "sum", "window_days": 3},
            {"type": "conversion", "name": "bought", "entity": "unit_id", "fact": "purchase", "window_days": 2},
            {"type": "retention", "name": "back", "entity": "unit_id", "fact": "click", "threshold_days": [2, 5]},
            {"type": "ratio", "name": "spend_per_click", "entity": "unit_id", "numerator": {"fact": "purchase", "aggregation": "sum", "window_days": 3}, "denominator": {"fact": "click", "aggregation": "count", "window_days": 3}},
            {"type": "active", "name": "buyers", "entity": "unit_id", "fact": "purchase"},
            {"type": "total", "name": "revenue", "entity": "unit_id", "fact": "purchase", "aggregation": "sum"},
        ],
        "experiments": [{"name": "demo", "exposure": "first_view", "unit": "unit_id", "control": "control", "start": START, "end": EDGE, "metrics": ["spend", "bought", "back", "spend_per_click"], "allocation": {"control": 0.5, "treatment": 0.5}}],
    }


def demo_view(spark, sf, name: str = "demo_events") -> str:
    f = facts(spark, sf).withColumns({"group_id": F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment"), "tier": (F.col("user_id") % 3).cast("string"), "experiment_id": F.lit(None).cast("string")})
    f.createOrReplaceTempView(name)
    return name


_DEMO = f"""WITH ev AS (SELECT user_id::VARCHAR AS unit_id, user_id, ts, event_type AS event, value FROM events),
x AS (SELECT unit_id, CASE WHEN any_value(user_id) % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_id, min(ts) AS fts, min(ts)::DATE AS fd FROM ev WHERE event = 'view' AND ts::DATE BETWEEN DATE '{START}' AND DATE '{EDGE}' GROUP BY 1),
p AS (SELECT e.unit_id, date_diff('day', fd, e.ts::DATE) AS off, event, value FROM ev e JOIN x USING (unit_id) WHERE e.ts > fts),
s AS (SELECT 'spend' AS metric, x.unit_id, group_id, coalesce((SELECT sum(value) FROM p WHERE p.unit_id = x.unit_id AND event = 'purchase' AND off < 3), 0) AS y FROM x WHERE fd + 2 <= DATE '{EDGE}'
  UNION ALL SELECT 'bought', x.unit_id, group_id, (EXISTS (SELECT 1 FROM p WHERE p.unit_id = x.unit_id AND event = 'purchase' AND value IS NOT NULL AND off < 2))::INT::DOUBLE FROM x WHERE fd + 1 <= DATE '{EDGE}'
  UNION ALL SELECT 'back', x.unit_id, group_id, (EXISTS (SELECT 1 FROM p WHERE p.unit_id = x.unit_id AND event = 'click' AND off >= 2 AND off < 5))::INT::DOUBLE FROM x WHERE fd + 4 <= DATE '{EDGE}'),
a AS (SELECT metric, group_id, avg(y) AS m FROM s GROUP BY ALL)
SELECT t.metric, t.group_id, round(t.m, 6) AS treatment, round(c.m, 6) AS control FROM a t JOIN a c ON t.metric = c.metric AND t.group_id = 'treatment' AND c.group_id = 'control'"""


@query(_DEMO)
def declared_experiment(spark, sf):
    reader = from_definitions(spark, demo_definitions(demo_view(spark, sf)), "demo")
    return rounded(reader.run(["spend", "bought", "back"]).select("metric", "group_id", "treatment", "control"))


_DAYS = f"""WITH ev AS (SELECT user_id::VARCHAR AS unit_id, user_id, ts, event_type AS event, value FROM events),
x AS (SELECT unit_id, CASE WHEN any_value(user_id) % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_id, min(ts) AS fts, min(ts)::DATE AS fd FROM ev WHERE event = 'view' AND ts::DATE BETWEEN DATE '{START}' AND DATE '{EDGE}' GROUP BY 1),
p AS (SELECT e.unit_id, e.ts::DATE AS d, sum(value) AS v FROM ev e JOIN x USING (unit_id) WHERE e.ts > fts AND event = 'purchase' AND value IS NOT NULL AND user_id % 3 = 1 AND date_diff('day', fd, e.ts::DATE) < 3 GROUP BY ALL),
days AS (SELECT unnest(generate_series((SELECT min(fd) FROM x), DATE '{EDGE}', INTERVAL 1 DAY))::DATE AS ds),
y AS (SELECT ds, group_id, x.unit_id, coalesce((SELECT sum(v) FROM p WHERE p.unit_id = x.unit_id AND {{match}}), 0) AS y FROM x JOIN days ON fd <= ds)
SELECT ds, group_id, count(*) AS n, round(avg(y), 5) AS ref_y, round(count(*) * var_pop(y), 3) AS cy2 FROM y GROUP BY ALL"""


def _filtered_reader(spark, sf):
    d = demo_definitions(demo_view(spark, sf))
    d["metrics"][0]["filters"] = [{"property": "tier", "op": "equals", "values": ["1"]}]
    return from_definitions(spark, d, "demo")


@query(_DAYS.format(match="d = ds"))
def declared_daily(spark, sf):
    """A filtered metric with a window, by calendar day."""
    return _filtered_reader(spark, sf).daily("spend").select("ds", "group_id", "n", F.round("ref_y", 5).alias("ref_y"), F.round("cy2", 3).alias("cy2"))


@query(_DAYS.format(match="d <= ds"))
def declared_asof(spark, sf):
    return _filtered_reader(spark, sf).asof("spend").select("ds", "group_id", "n", F.round("ref_y", 5).alias("ref_y"), F.round("cy2", 3).alias("cy2"))


@query(f"""WITH ev AS (SELECT user_id::VARCHAR AS unit_id, user_id, ts, event_type AS event, value FROM events),
x AS (SELECT unit_id, any_value(user_id) AS u, min(ts) AS fts, min(ts)::DATE AS fd FROM ev WHERE event = 'view' AND ts::DATE BETWEEN DATE '{START}' AND DATE '{EDGE}' GROUP BY 1),
t AS (SELECT x.unit_id, (u % 3)::VARCHAR AS segment, u // 7 AS cluster, CASE WHEN (u // 7) % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_id,
  coalesce((SELECT sum(value) FROM ev e WHERE e.unit_id = x.unit_id AND e.event = 'purchase' AND e.ts > fts AND date_diff('day', fd, e.ts::DATE) < 3), 0) AS y FROM x WHERE fd + 2 <= DATE '{EDGE}'),
c AS (SELECT segment, group_id, cluster, sum(y) AS s, count(*)::DOUBLE AS k FROM t GROUP BY ALL),
a AS (SELECT segment, group_id, count(*) AS n, avg(s) AS ms, avg(k) AS mk, var_samp(s) AS vs, var_samp(k) AS vk, covar_samp(s, k) AS csk FROM c GROUP BY ALL),
r AS (SELECT segment, group_id, n, ms / mk AS r, (vs - 2 * ms / mk * csk + pow(ms / mk, 2) * vk) / (n * ms * ms) AS v FROM a)
SELECT t.segment, t.group_id, round(t.r, 6) AS treatment, round(c.r, 6) AS control, round(t.r / c.r - 1, 6) AS lift, round(sqrt(t.v + c.v), 6) AS se FROM r t JOIN r c ON t.segment = c.segment AND t.group_id = 'treatment' AND c.group_id = 'control' WHERE t.r > 0 AND c.r > 0 AND t.n > 1 AND c.n > 1""")
def declared_clustered_breakout(spark, sf):
    """Clusters of seven users, collapsed within each segment."""
    demo_view(spark, sf)
    arm = F.when(F.floor(F.col("user_id") / 7) % 2 == 0, "control").otherwise("treatment")
    spark.table("demo_events").withColumns({"group_id": arm, "house": F.floor(F.col("user_id") / 7)}).createOrReplaceTempView("demo_clustered")
    d = demo_definitions("demo_clustered")
    d["experiments"][0]["cluster"] = "house"
    r = from_definitions(spark, d, "demo").breakout("spend", ["tier"]).filter("treatment > 0 AND control > 0 AND se IS NOT NULL")
    return r.select("segment", "group_id", *(F.round(c, 6).alias(c) for c in ("treatment", "control", "lift", "se")))


@query("SELECT ts::DATE AS period, count(DISTINCT user_id) AS value FROM events WHERE event_type = 'purchase' AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def declared_trend(spark, sf):
    from ..plans.definitions import load_definitions

    trends = MetricTrends(spark, load_definitions(demo_definitions(demo_view(spark, sf))), "unit_id")
    return trends.metric("buyers", "day", "2024-01-05", "2024-01-20").filter("value > 0").select("period", "value")


@query(_TOT + ", f AS (SELECT group_id, y FROM t)" + _LIFT.format(source="f"))
def frame_summary_lift(spark, sf):
    t = _sums(spark, sf).select("unit_id", F.col("group_id").alias("variant"), "y")
    r = frames.from_unit_summary(t, "unit_id", "variant", {"y": "mean"}, "control").run()
    return rounded(r.drop("metric"))


@query("""WITH d AS (SELECT user_id::VARCHAR AS unit_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, ts::DATE AS ds, min(ts::DATE) OVER (PARTITION BY user_id) AS fd, coalesce(value, 0) AS v FROM events WHERE event_type = 'purchase'),
u AS (SELECT unit_id, variant, sum(v) FILTER (ds >= fd AND date_diff('day', fd, ds) < 5) AS y FROM d GROUP BY ALL) SELECT variant AS group_id, count(*) AS n, round(avg(y), 6) AS ref_y FROM u GROUP BY 1""")
def frame_panel_moments(spark, sf):
    from pyspark.sql import Window

    f = facts(spark, sf).filter("event = 'purchase'").withColumn("ds", F.to_date("ts"))
    p = f.select("unit_id", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant"), "ds", F.coalesce("value", F.lit(0.0)).alias("spend"))
    first = p.groupBy("unit_id").agg(F.min("ds").alias("exposed"))
    e = frames.from_unit_panel(p.join(first, "unit_id"), "unit_id", "variant", "ds", "exposed", ["spend"], "control", 5)
    return rounded(e.moments("spend").select("group_id", "n", "ref_y"))


@query("""WITH h AS (SELECT c_custkey, ('0x' || substr(sha256('4:demo' || length(c_custkey::VARCHAR) || ':' || c_custkey), 1, 15))::BIGINT % 10000 AS slot FROM customer) SELECT c_custkey, slot, CASE WHEN slot < 3000 THEN 'a' WHEN slot < 9000 THEN 'b' ELSE 'c' END AS arm FROM h""")
def hash_allocation(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", assignment.slot(F.col("c_custkey"), "demo").alias("slot"), assignment.allocate(F.col("c_custkey"), "demo", {"a": 3000, "b": 6000, "c": 1000}).alias("arm"))


@query(_TOT + " SELECT group_id, count(*) AS n, round(avg(y), 6) AS ref_y, round(count(*) * var_pop(y), 4) AS cy2 FROM t GROUP BY 1")
def moments_cube(spark, sf):
    at = scratch(spark)
    parts = M.group_summary(_sums(spark, sf).withColumn("part", F.col("unit_id").cast("long") % 3), ["group_id", "part"])
    stores.export_moments([parts], at)
    m = M.merge(stores.read_moments(spark, at), ["group_id"])
    return m.select("group_id", "n", F.round("ref_y", 6).alias("ref_y"), F.round("cy2", 4).alias("cy2"))


@query(BASE + "z AS (SELECT 1) SELECT group_id, count(*) AS n FROM x GROUP BY 1")
def artifact_roundtrip(spark, sf):
    from ..schemas import EXPOSURES

    store = stores.ArtifactStore(spark, scratch(spark))
    generation = store.publish({"exposures": exposures(spark, sf).withColumn("experiment_id", F.lit("demo"))}, {"exposures": EXPOSURES})
    return store.open(generation)["exposures"].groupBy("group_id").agg(F.count("*").alias("n"))


@query("SELECT ts::DATE::TIMESTAMP AS period, count(*) AS n_events, round(sum(value), 6) AS sum_value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def streamed_daily_totals(spark, sf):
    at = scratch(spark)
    facts(spark, sf).select("unit_id", "ts", "event", "value").write.parquet(f"{at}/in")
    s = stream.tumbling_totals(stream.read_events(spark, f"{at}/in"), "purchase", late="60 days")
    q = s.writeStream.format("memory").outputMode("complete").queryName(name := f"s{uuid.uuid4().hex}").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("period", "n_events", F.round("sum_value", 6).alias("sum_value"))


@query("SELECT user_id % 2 AS arm, count(value) AS n, round(avg(value), 6) AS ref_y, round(var_pop(value), 4) AS var FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1")
def streamed_moments(spark, sf):
    at = scratch(spark)
    facts(spark, sf).filter("event = 'purchase'").select("unit_id", "ts", "event", "value").repartition(3).write.parquet(f"{at}/in")
    values = stream.read_events(spark, f"{at}/in").select((F.col("unit_id").cast("long") % 2).alias("arm"), F.col("value").alias("y"))
    stream.into_moments(values, ["arm"], f"{at}/moments", f"{at}/cp").awaitTermination()
    m = stream.current_moments(spark, f"{at}/moments", ["arm"])
    return m.select("arm", "n", F.round("ref_y", 6).alias("ref_y"), F.round(F.col("cy2") / F.col("n"), 4).alias("var"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def admitted_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_source")
    return spark.sql(admit_read_only_sql("WITH o AS (SELECT * FROM orders_source) SELECT o_orderstatus, count(*) AS n FROM o GROUP BY 1;"))


@query(None)
def power_curve(spark, sf):
    base = power.planning_baseline(table(spark, sf, "orders").withColumn("y", F.col("o_totalprice")))
    return power.power_curve(spark, [0.01, 0.02, 0.05], [1000, 10_000, 100_000], base["cv"])
