"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, source mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents; all but the last return the columns of ``documents``.  As that is so, a stage that is called by itself
deletes what the stage before it on the same tables left in the shared folder; ``run`` deletes what its own stages wrote as
soon as their result is written, and nothing else.

Null and empty texts go at the first stage, with all that have no language; a table without rows runs through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, langid, mixing, neardup, trainorder
from tidegauge.llm.common import Intermediates, read, written

#: A row whose language's score is under this goes, as does one of no language.
LEAST_LANGUAGE_SCORE = 0.1
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage wrote that was called by itself, by application and tables.
_before: dict[tuple[str, str], Intermediates] = {}


def _stage(make: Stage) -> Stage:
    @wraps(make)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if Intermediates.current() is not None:
            return make(spark, docs, sf_dir)
        own = _before.setdefault((spark.sparkContext.applicationId, sf_dir), Intermediates())
        own.drop(spark)
        with own:
            return make(spark, docs, sf_dir)

    return call


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.recognised(docs, langid.train(docs.select("doc_id", "text", "lang")), LEAST_LANGUAGE_SCORE)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, entropy=mixing.ENTROPY, repeats=mixing.REPEATS)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return trainorder.training_order(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can't express the trained classifier, the forest or the token files; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Intermediates() as own:
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
        own.drop(spark)
    with Intermediates():
        return STAGES[-1][1](spark, docs, sf_dir)
