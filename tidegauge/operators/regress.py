"""Regression over distributed rows: Gram matrices, tall-skinny QR, joint categorical cells, interacted adjustment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, columns: list[str], y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Per group: n, sums, and cross products centred on the group's means (a wide aggregation, merged map-side)."""
    every = [*columns, y]
    aggs = [F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in every)]
    aggs += [(F.count("*") * F.covar_pop(a, b)).alias(f"s_{a}_{b}") for i, a in enumerate(every) for b in every[i:]]
    return rows.groupBy(*(by or [])).agg(*aggs) if by else rows.agg(*aggs)


def solve_gram(row: dict, columns: list[str], y: str = "y") -> dict[str, float]:
    """Least-squares coefficients (and the intercept) from one row of `gram`."""
    s = lambda a, b: row.get(f"s_{a}_{b}", row.get(f"s_{b}_{a}"))
    beta = np.linalg.solve(np.array([[s(a, b) for b in columns] for a in columns]), np.array([s(a, y) for a in columns]))
    out = dict(zip(columns, map(float, beta), strict=True))
    return out | {"intercept": row[f"mean_{y}"] - sum(out[c] * row[f"mean_{c}"] for c in columns)}


def tsqr(rows: DataFrame, columns: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """(R, Q'y, n) of the design: a local QR per batch, merged within the partition, then over partitions in two levels.

    Each partition sends one (p+1) x (p+1) triangle; with many partitions they are merged in about their square root of
    tasks before the driver merges the rest.
    """
    p = len(columns) + 1
    design = rows.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate([*columns, y]))).dropna()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, p)), 0
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]) if len(batch) else np.zeros((0, p))
            n += len(x)
            r = np.linalg.qr(np.vstack([r, x]), mode="r") if len(x) else r
        yield pa.RecordBatch.from_pydict({"r": [r.tobytes()], "rows": [len(r)], "n": [n]}, schema=pa.schema([("r", pa.binary()), ("rows", pa.int64()), ("n", pa.int64())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, p)), 0
        for batch in batches:
            for raw, k, m in zip(batch.column("r").to_pylist(), batch.column("rows").to_pylist(), batch.column("n").to_pylist(), strict=True):
                n += m
                if k:
                    r = np.linalg.qr(np.vstack([r, np.frombuffer(raw).reshape(k, p)]), mode="r")
        yield pa.RecordBatch.from_pydict({"r": [r.tobytes()], "rows": [len(r)], "n": [n]}, schema=pa.schema([("r", pa.binary()), ("rows", pa.int64()), ("n", pa.int64())]))

    schema = "r binary, rows long, n long"
    local = design.mapInArrow(reduce, schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = local.repartition(max(1, math.isqrt(parts))).mapInArrow(merge, schema)
    r, n = np.zeros((0, p)), 0
    for x in local.collect():  # about the square root of the partitions
        n += x.n
        if x.rows:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(x.r).reshape(x.rows, p)]), mode="r")
    k = p - 1
    return r[:k, :k], r[:k, k], n


def least_squares(rows: DataFrame, columns: list[Column], y: Column) -> np.ndarray:
    r, qy, _ = tsqr(rows, columns, y)
    return np.linalg.solve(r, qy)


def interacted(rows: DataFrame, covariates: list[str], treated: Column, y: str = "y") -> dict:
    """Regression adjustment with centred, interacted covariates: effect, HC2 error (a second pass for the leverages)."""
    means = rows.agg(*(F.avg(c).alias(c) for c in covariates)).first()
    d = treated.cast("double")
    centred = [F.col(c) - F.lit(float(means[c])) for c in covariates]
    design = [F.lit(1.0), d, *centred, *(d * c for c in centred)]
    r, qy, n = tsqr(rows, design, F.col(y))
    beta = np.linalg.solve(r, qy)
    inverse = np.linalg.inv(r.T @ r)
    fit = sum((F.lit(float(b)) * c for b, c in zip(beta, design, strict=True)), F.lit(0.0))
    h = F.lit(0.0)
    for i, a in enumerate(design):
        for j, b in enumerate(design):
            if abs(inverse[i, j]) > 0:
                h = h + F.lit(float(inverse[i, j])) * a * b
    score = sum((F.lit(float(inverse[1, j])) * c for j, c in enumerate(design)), F.lit(0.0))  # row of (X'X)^-1 X'
    var = rows.select((F.pow(score * (F.col(y) - fit), 2) / F.greatest(F.lit(1e-12), 1 - h)).alias("v")).agg(F.sum("v")).first()[0]
    return {"effect": float(beta[1]), "se": math.sqrt(var), "n": n, "beta": beta.tolist(), "covariates": covariates}


def cate_scores(rows: DataFrame, fit: dict, means: dict[str, float]) -> DataFrame:
    """``rows`` with score: the treatment effect that an interacted fit predicts."""
    k = len(fit["covariates"])
    score = F.lit(fit["beta"][1])
    for c, b in zip(fit["covariates"], fit["beta"][2 + k :], strict=True):
        score = score + F.lit(float(b)) * (F.col(c) - F.lit(float(means[c])))
    return rows.withColumn("score", score)


def cells(rows: DataFrame, factors: list[str], y: str = "y") -> DataFrame:
    """Joint cells of arm and factor levels: n, mean, centred square sum."""
    return rows.groupBy("group_id", *(F.coalesce(F.col(f).cast("string"), F.lit("<missing>")).alias(f) for f in factors)).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), (F.count("*") * F.var_pop(y)).alias("ss"))


def post_stratified(cell_rows: DataFrame, factors: list[str], control: str) -> DataFrame:
    """The effect of a fit saturated in the factors: cell differences weighted by the cells' shares of all units."""
    part = lambda on: [F.sum(F.when(on, F.col("n"))).alias("n"), F.max(F.when(on, F.col("mean"))).alias("m"), F.max(F.when(on, F.col("ss"))).alias("s")]
    t, c = part(F.col("group_id") != control), part(F.col("group_id") == control)
    g = cell_rows.groupBy(*factors).agg(*(x.alias(f"{n}t") for x, n in zip(t, "nms", strict=True)), *(x.alias(f"{n}c") for x, n in zip(c, "nms", strict=True))).filter("nt > 1 AND nc > 1")
    size = F.col("nt") + F.col("nc")
    v = F.col("st") / (F.col("nt") - 1) / F.col("nt") + F.col("sc") / (F.col("nc") - 1) / F.col("nc")
    return g.agg(F.count("*").alias("cells"), F.sum(size).alias("n"), (F.sum(size * (F.col("mt") - F.col("mc"))) / F.sum(size)).alias("effect"), (F.sqrt(F.sum(size * size * v)) / F.sum(size)).alias("se"))


def encoded(rows: DataFrame, factor: str, levels: list[str]) -> DataFrame:
    """Indicator columns of all levels but the first, and of missing values."""
    made = {f"{factor}={x}": (F.col(factor) == x).cast("double") for x in levels[1:]}
    return rows.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in made.items()} | {f"{factor}=<missing>": F.col(factor).isNull().cast("double")})


def input_digest(rows: DataFrame) -> DataFrame:
    """Order-independent digest of a relation: rows and the sum of their 64-bit hashes."""
    return rows.select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("digest"))
