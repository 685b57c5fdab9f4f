"""Missing values of frames, row scopes and set operations of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def _absent(df: DataFrame, c: str) -> Column:
    missing = F.col(c).isNull()
    return missing | F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else missing


def zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(_absent(df, c), 0.0).otherwise(F.col(c)) for c in columns})


def pooled_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's mean over all rows, arms together (one row is broadcast)."""
    means = df.agg(*(F.avg(F.when(~_absent(df, c), F.col(c))).alias(f"_mean_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(means)).withColumns({c: F.when(_absent(df, c), F.col(f"_mean_{c}")).otherwise(F.col(c)) for c in columns})
    return out.drop(*(f"_mean_{c}" for c in columns))


def drop_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a | b, (_absent(df, c) for c in columns)))


def missing_accounts(df: DataFrame, columns: list[str], by: str = "group_id") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(_absent(df, c)).alias(f"missing_{c}") for c in columns))


def apply_missing(df: DataFrame, column: str, policy: str) -> DataFrame:
    """One column's policy: error, zero, skip, impute or drop."""
    if policy == "error":
        n = df.filter(_absent(df, column)).count()
        if n:
            raise EngineError("frame.missing_values", f"{n} missing values of {column}", column=column, rows=n)
        return df
    return {"zero": zeros, "impute": pooled_mean, "skip": drop_null, "drop": drop_null}[policy](df, [column])


def restrict_to_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    return rows.join(units.select("unit_id"), "unit_id", "left_semi")


def outside_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    return rows.join(units.select("unit_id"), "unit_id", "left_anti")


def tagged_union(streams: dict[str, DataFrame]) -> DataFrame:
    """All streams in one relation with a _stream tag; columns are matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("_stream", F.lit(name)) for name, df in streams.items()))


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def non_finite_counts(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    return rows.agg(F.count_if(c.isNull()).alias("nulls"), F.count_if(F.isnan(c)).alias("nans"), F.count_if(F.abs(c) == float("inf")).alias("infinities"))
