"""Operator 3, exact dedup by content sort, in DataFrame operations only.

Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``.  Rows are range-partitioned on their
normalised text by sampled splitters (its first characters, then a hash: what the driver samples stays short), sorted
externally on the whole normalised text, and neighbouring full comparisons end the groups.

A text that a large share of the rows repeats would land in one range: a first pass counts rows by SHA-256, and texts over
``max(256, rows / 20000)`` rows, at most 20,000 of them, are salted over as many sub-ranges as that needs; what stays of
them was settled by the first pass.

Defined cases: a null text counts as empty, and all empty texts are one group; of rows that share a doc_id and a text one
stays; a null doc_id loses against any other of its length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

#: The characters that equality ignores.
IGNORED = " \t\n\x0b\x0c\r"
MOST_HOT = 20_000
LEAST_HOT_ROWS = 256


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts, the row with the most code points in its original text, then the smallest doc_id, stays.
    """
    norm = normalised(F.col("text"))
    chars = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select("doc_id", chars.alias("n_chars"), norm.alias("norm"))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    rows = docs.count()
    most = max(LEAST_HOT_ROWS, -(-rows // MOST_HOT))
    hot = written(
        keyed.groupBy(F.sha2("norm", 256).alias("text_sha256")).agg(F.count("*").alias("hot_size"), best.alias("best"))
        .filter(F.col("hot_size") > most).select("text_sha256", "hot_size", F.col("best.id").alias("hot_keep")),
        "hot-texts",
    )
    # rows / most <= MOST_HOT rows of under 100 bytes
    salted = keyed.withColumn("text_sha256", F.sha2("norm", 256)).join(F.broadcast(hot), "text_sha256", "left")
    salted = salted.select(
        "*", F.substring("norm", 1, 48).alias("head"), F.xxhash64("norm").alias("hash"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("hot_size") / F.lit(most))), F.lit(0)).alias("salt"),
    )
    ranged = salted.repartitionByRange("head", "hash", "salt")
    run = Window.partitionBy("head", "hash", "salt", "norm").orderBy(F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = ranged.select(
        "doc_id", "text_sha256", "hot_size", "hot_keep", "n_chars",
        F.first("doc_id").over(whole).alias("run_keep"), F.count("*").over(whole).alias("run_size"), F.row_number().over(run).alias("place"),
    )
    keep = F.when(F.col("hot_size").isNull(), F.col("run_keep")).otherwise(F.col("hot_keep"))
    return settled.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("hot_size", "run_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256", F.col("n_chars").cast("long").alias("n_chars"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place FROM d
      WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256, n AS n_chars FROM g
"""
