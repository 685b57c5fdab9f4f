"""Parquet stores: moment cubes, results of runs, decision log, immutable unit-day artifacts with digests."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schemas import PRIMARY_KEYS, conform


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


# --- moments


def export_moments(parts: list[DataFrame], path: str) -> None:
    """Moment rows over the union of their columns."""
    from functools import reduce

    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("errorifexists").parquet(path)


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- results


class ResultsStore:
    """One create-only folder per run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, rows: DataFrame, experiment: str, run_id: str | None = None) -> str:
        run_id = run_id or uuid.uuid4().hex
        at = f"{self.root}/runs/experiment_id={experiment}/run_id={run_id}"
        if exists(self.spark, at):
            raise EngineError("store.run_exists", f"{run_id!r}", run_id=run_id)
        rows.withColumn("saved_at", F.current_timestamp()).write.parquet(at)
        return run_id

    def load(self, experiment: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/runs/experiment_id={experiment}/run_id={run_id}")

    def history(self, experiment: str) -> DataFrame:
        """All runs, each row with the previous run's lift."""
        runs = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/runs").filter(F.col("experiment_id") == experiment)
        line = Window.partitionBy("metric", "group_id").orderBy("saved_at")
        return runs.withColumn("previous_lift", F.lag("lift").over(line))

    def log_decision(self, experiment: str, event: dict) -> None:
        row = [(experiment, dt.datetime.now(dt.UTC).isoformat(), json.dumps(event, sort_keys=True))]
        self.spark.createDataFrame(row, "experiment_id string, at string, event string").coalesce(1).write.mode("append").parquet(f"{self.root}/decisions")

    def decisions(self, experiment: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/decisions").filter(F.col("experiment_id") == experiment).orderBy("at")


# --- artifacts


def _token(name: str, t: str) -> Column:
    c = F.col(f"`{name}`")
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if t == "timestamp" else F.hex(c.cast("binary")) if t == "binary" else c.cast("string")
    return F.when(c.isNull(), F.lit("n;")).otherwise(F.concat(F.length(text), F.lit(":"), text, F.lit(";")))


def row_digest(df: DataFrame) -> DataFrame:
    """Each row's SHA-256 over its length-prefixed values in column order."""
    return df.select(F.sha2(F.concat(*(_token(c, t) for c, t in df.dtypes)), 256).alias("row_sha"))


def relation_digest(df: DataFrame, buckets: int = 4096) -> str:
    """SHA-256 of a relation, whatever its order and partitioning: rows are bucketed by their own hash, each bucket's sorted
    hashes are hashed (a bucket's size grows with rows / buckets), and the driver hashes one digest per bucket."""
    import hashlib

    rows = row_digest(df).groupBy("row_sha").count()  # repeated rows become a count
    bucket = F.pmod(F.conv(F.substring("row_sha", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    parts = rows.groupBy(bucket.alias("bucket")).agg(F.sha2(F.concat_ws(";", F.sort_array(F.collect_list(F.concat("row_sha", F.lit("x"), F.col("count").cast("string"))))), 256).alias("sha"), F.sum("count").alias("n"))
    found = sorted((r.bucket, r.sha, r.n) for r in parts.collect())
    return hashlib.sha256(json.dumps([list(df.columns), found]).encode()).hexdigest()


def check_keys(df: DataFrame, role: str) -> None:
    keys = PRIMARY_KEYS[role]
    bad = df.groupBy(*keys).count().filter(" OR ".join(["count > 1", *(f"{k} IS NULL" for k in keys)]))
    if bad.limit(1).count():
        raise EngineError("artifact.primary_key", f"{role}: {keys}", role=role)


class ArtifactStore:
    """Generations of typed relations: relations first, the manifest last; a reader sees only whole generations."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, relations: dict[str, DataFrame], contracts: dict[str, dict[str, str]]) -> str:
        generation = uuid.uuid4().hex
        manifest = {}
        for role, df in relations.items():
            out = conform(df, contracts[role], extra=False)
            if role in PRIMARY_KEYS:
                check_keys(out, role)
            at = f"{self.root}/{generation}/{role}"
            out.write.parquet(at)
            manifest[role] = {"digest": relation_digest(self.spark.read.parquet(at)), "columns": list(contracts[role])}
        if {"exposures", "measure_stats"} <= set(relations):
            outside = relations["measure_stats"].join(relations["exposures"], ["experiment_id", "unit_id"], "left_anti").limit(1).count()
            if outside:
                raise EngineError("artifact.coverage", "measure_stats holds units that aren't exposed")
        put_json(self.spark, f"{self.root}/{generation}/manifest.json", manifest)
        return generation

    def open(self, generation: str, verify: bool = True) -> dict[str, DataFrame]:
        at = f"{self.root}/{generation}"
        if not exists(self.spark, f"{at}/manifest.json") or exists(self.spark, f"{at}/dropped.json"):
            raise EngineError("artifact.no_generation", f"{generation!r}", generation=generation)
        manifest = get_json(self.spark, f"{at}/manifest.json")
        out = {role: self.spark.read.parquet(f"{at}/{role}").select(*m["columns"]) for role, m in manifest.items()}
        for role, df in out.items() if verify else ():
            if relation_digest(df) != manifest[role]["digest"]:
                raise EngineError("artifact.digest", f"{role} isn't what was published", role=role)
        return out

    def drop(self, generation: str) -> None:
        """A tombstone: later opens refuse."""
        put_json(self.spark, f"{self.root}/{generation}/dropped.json", {"dropped": True})


def pin(streams: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """One snapshot of several streams, written once, so that every later read sees the same rows."""
    out = {}
    for name, df in streams.items():
        df.write.parquet(f"{root}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
    return out
