"""Runs the headline queries and prints one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tidegauge.catalog import QUERIES
from tidegauge.catalog.misc import demo_definitions, demo_view
from tidegauge.plans.experiment import from_definitions

#: The experiment's path from events to readouts, the calendar reports, dimensions and study designs.
HEADLINE = [
    "first_exposures", "post_exposure_stats", "group_summary_sum", "lift_mean", "lift_conversion", "lift_ratio", "cuped_lift", "cluster_summary", "encouragement_late",
    "winsorized_summary", "breakouts_in_one_pass", "daily_moments", "asof_moments", "sequential_looks", "trend_sum_day", "trend_conversion_week_sunday", "rolling_active_7d",
    "asof_property", "dim_changelog_join", "switchback_effect", "logged_policy_contrast", "gram_matrix", "segment_heterogeneity",
]


def workload(spark: SparkSession, sf: str, repeats: int = 7) -> dict:
    """A conversion, a mean and a ratio metric, overall, by one breakout and by day: from one reader (measures captured once) and
    from a reader for each operation; medians after one warm-up, and the Spark jobs of a run."""
    definitions = demo_definitions(demo_view(spark, sf))
    metrics = ["spend", "bought", "spend_per_click"]
    work = [
        lambda r: r.run(metrics).collect(), lambda r: [r.breakout(m, ["tier"]).collect() for m in metrics], lambda r: [r.daily(m).collect() for m in metrics[:2]],
    ]
    out = {}
    for name, groups in (("captured", [work]), ("per_operation", [[w] for w in work])):
        took, jobs = [], 0
        for k in range(repeats + 1):
            spark.sparkContext.setJobGroup(f"{name}-{k}", name)
            t = time.perf_counter()
            for group in groups:
                reader = from_definitions(spark, definitions, "demo")
                for w in group:
                    w(reader)
                reader.close()
            took.append(time.perf_counter() - t)
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name}-{k}"))
        out[name] = {"median": round(median(took[1:]), 4), "jobs": jobs}
    return out


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # the first query pays for starting up
    took = {}
    for name in HEADLINE:
        run(name)  # compiled code for each, as a reader that stays open has it
        t = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - t, 4)
    a = workload(spark, sf)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "workload_a": a, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
