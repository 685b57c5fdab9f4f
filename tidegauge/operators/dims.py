"""Dimensions: plain, validity-range and changelog sources, joined to facts; pre-exposure values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError

OPEN_END = "9999-12-31 00:00:00"


def duplicates(dim: DataFrame, entity: str) -> DataFrame:
    return dim.groupBy(entity).count().filter("count > 1")


def overlaps(ranges: DataFrame, entity: str) -> DataFrame:
    """Rows whose range begins before an earlier one of the entity ends."""
    order = Window.partitionBy(entity).orderBy("valid_from", "valid_to")
    end = F.coalesce("valid_to", F.lit(OPEN_END).cast("timestamp"))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("before", before).filter(F.col("before") > F.col("valid_from")).drop("before")


def changelog_ranges(log: DataFrame, entity: str) -> DataFrame:
    """Validity ranges of a changelog (entity, changed_at, properties)."""
    order = Window.partitionBy(entity).orderBy("changed_at")
    return log.withColumns({"valid_from": F.col("changed_at"), "valid_to": F.lead("changed_at").over(order)}).drop("changed_at")


def check(dim: DataFrame, entity: str, kind: str) -> None:
    """Refuses duplicates of a plain source, ties of a changelog, overlaps of ranges."""
    bad, code = {
        "plain": lambda: (duplicates(dim, entity), "dims.duplicate_entity"),
        "changelog": lambda: (dim.groupBy(entity, "changed_at").count().filter("count > 1"), "dims.tied_changes"),
        "ranges": lambda: (overlaps(dim, entity), "dims.overlapping_ranges"),
    }[kind]()
    some = [r[entity] for r in bad.limit(5).collect()]
    if some:
        raise EngineError(code, f"{entity}: {some}", entities=some)


def join_plain(facts: DataFrame, dim: DataFrame, entity: str) -> DataFrame:
    """A left join on the entity; facts keep their rows.  Spark broadcasts the dimension when its size allows."""
    clash = [c for c in dim.columns if c != entity and c in facts.columns]
    if clash:
        raise EngineError("dims.name_collision", f"columns {clash}", columns=clash)
    return facts.join(dim, entity, "left")


def join_ranges(facts: DataFrame, ranges: DataFrame, entity: str, at: str = "ts") -> DataFrame:
    """A left join on the entity and valid_from <= time < valid_to; an open end is a far date, set before the join."""
    clash = [c for c in ranges.columns if c not in (entity, "valid_from", "valid_to") and c in facts.columns]
    if clash:
        raise EngineError("dims.name_collision", f"columns {clash}", columns=clash)
    r = ranges.withColumn("valid_to", F.coalesce("valid_to", F.lit(OPEN_END).cast("timestamp"))).withColumnRenamed(entity, "_entity")
    on = (facts[entity] == r["_entity"]) & (facts[at] >= r["valid_from"]) & (facts[at] < r["valid_to"])
    return facts.join(r, on, "left").drop("_entity", "valid_from", "valid_to")


def join_changelog(facts: DataFrame, log: DataFrame, entity: str, at: str = "ts") -> DataFrame:
    return join_ranges(facts, changelog_ranges(log, entity), entity, at)


def pre_exposure_property(exposures: DataFrame, observations: DataFrame, prop: str) -> DataFrame:
    """(unit_id, prop): the latest value strictly before exposure, of equal times the largest; null without one."""
    early = observations.select("unit_id", "ts", prop).join(exposures.select("unit_id", "first_exposure_ts"), "unit_id").filter(F.col("ts") < F.col("first_exposure_ts"))
    last = early.groupBy("unit_id").agg(F.max(F.struct("ts", prop)).alias("last")).select("unit_id", F.col(f"last.{prop}").alias(prop))
    return exposures.select("unit_id").join(last, "unit_id", "left")


def static_property(observations: DataFrame, prop: str) -> DataFrame:
    return observations.groupBy("unit_id").agg(F.max(prop).alias(prop))
