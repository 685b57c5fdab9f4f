"""The demonstration experiment on the driver's tables, and the register of queries with their SQL.

Events are the fact source; a unit is a user; the first view of a user inside [START, END] exposes it, in the arm of the
user's parity (a few users switch arms and are mixed); EDGE is the last observable day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exposures as X
from ..operators import outcomes as O

START, END, EDGE = "2024-01-03", "2024-01-20", "2024-01-24"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summing doesn't show."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("unit_id"), "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def arm(user: str = "user_id", event: str = "event_id"):
    switch = (F.col(user) % 29 == 0) & (F.col(event) % 2 == 0)
    even = (F.col(user) % 2 == 0) != switch
    return F.when(even, "control").otherwise("treatment")


def exposure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter("event = 'view'").select("unit_id", "ts", F.lit("demo").alias("experiment_id"), arm().alias("group_id"), (F.col("user_id") % 20).cast("string").alias("cluster_id"))


def exposures(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return X.first_exposures(exposure_rows(spark, sf_dir), None, START, END, carry=carry)


def events_of(spark: SparkSession, sf_dir: str, event: str, value: str | None = "value", missing: str = "skip") -> DataFrame:
    return O.metric_events(facts(spark, sf_dir), event, value, missing=missing)


def stats_of(spark: SparkSession, sf_dir: str, event: str, value: str | None = "value") -> DataFrame:
    return O.post_exposure_stats(events_of(spark, sf_dir, event, value), exposures(spark, sf_dir))


#: SQL of the same, to stand before a query's own.
BASE = f"""
WITH ev AS (SELECT user_id::VARCHAR AS unit_id, user_id, event_id, ts, event_type AS event, value, (props->>'$.k')::INT AS k FROM events),
xr AS (SELECT unit_id, ts, user_id, CASE WHEN (user_id % 2 = 0) <> (user_id % 29 = 0 AND event_id % 2 = 0) THEN 'control' ELSE 'treatment' END AS group_id FROM ev
       WHERE event = 'view' AND ts::DATE BETWEEN DATE '{START}' AND DATE '{END}'),
x AS (SELECT unit_id, arg_min(group_id, ts) AS group_id, min(ts) AS fts, min(ts)::DATE AS fd, (any_value(user_id) % 20)::VARCHAR AS cluster_id FROM xr GROUP BY unit_id HAVING count(DISTINCT group_id) = 1),
"""


def stats_sql(name: str, event: str, value: str = "value") -> str:
    return f"""{name} AS (SELECT e.unit_id, x.group_id, e.ts::DATE AS ds, date_diff('day', x.fd, e.ts::DATE) AS off, count(*) AS n, sum({value}) AS s, min({value}) AS lo, max({value}) AS hi
  FROM ev e JOIN x USING (unit_id) WHERE e.event = '{event}' AND e.ts > x.fts {"AND value IS NOT NULL" if value == "value" else ""} GROUP BY ALL)"""


def moments_sql(source: str, keys: str = "group_id") -> str:
    return f"SELECT {keys}, count(y) AS n, round(avg(y), 6) AS ref_y, 0.0::DOUBLE AS cy1, round(count(y) * var_pop(y), 4) AS cy2 FROM {source} WHERE y IS NOT NULL GROUP BY {keys}"


def rounded_moments(df: DataFrame) -> DataFrame:
    """References to 6 digits, centred sums to 4."""
    return df.select(*((F.round(F.col(c), 6 if c.startswith("ref") else 4) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
