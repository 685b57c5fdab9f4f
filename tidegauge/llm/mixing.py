"""Operator 9, mixing sources to target weights, in DataFrame operations only.

Temperature mixing: a source's weight is its token share to a power a in [0, 1], normalised.  The exponent is bisected:
with ``entropy`` (a part of the largest entropy, log of the number of sources) the largest a that reaches it; with
``repeats`` the smallest a at which no source is repeated more than that; of both, the larger, so that the limit holds.

The weights are realised by budgeted block permutations.  Each source's rows are hashed into blocks (256 rows on average,
4,096 blocks at most); blocks are put in a keyed order; a source whose budget is q of its tokens is used floor(q) times
whole and then block after block, the last one row after row in a keyed order, while the rest of its budget holds.  The
budget is ``budget`` tokens, or, without one, the least at which every row is used at least once.

Tokens are the maximal runs of characters other than white space; a row counts as one token at least.

Defined cases: a null source is a source of its own; a null or empty text is one token; repeated rows are placed alike; one
source gets weight 1; an empty table gives an empty result.  A row of a source over its budget may be used 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fields, read, written

BLOCK_ROWS = 256
MOST_BLOCKS = 4096
#: Rows of the block table that are broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 200_000
_STEPS = 50


def keyed_hash(seed: int, *columns: Column) -> Column:
    """32 bits of the MD5 of the seed and the columns' text."""
    parts = [F.lit(str(seed))]
    for c in columns:
        parts += [F.lit("|"), F.coalesce(c.cast("string"), F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))).cast("long")


def source_weights(shares: DataFrame, *, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """``shares`` (source, tokens, rows) with weight, exponent and quota: times that each source is used.

    The shares are gathered as one array of a number for each source.
    """
    whole = shares.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("t"), F.sum("tokens").cast("double").alias("total"))
    whole = whole.select(F.transform("t", lambda x: x / F.col("total")).alias("p"), "total")

    def mass(a: Column) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x, a))

    def reached(a: Column) -> Column:
        inner = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x, a) * F.log(x))
        return F.log(mass(a)) - a * inner / mass(a) >= F.lit(entropy) * F.log(F.size("p").cast("double"))

    def most_used(a: Column) -> Column:
        small, large = F.array_min("p"), F.array_max("p")
        if budget is None:
            return F.pow(small / large, a - 1)
        return F.pow(small, a - 1) / mass(a) * F.lit(float(budget)) / F.col("total")

    def bisect(ok, high_side: bool) -> Column:
        """The largest a at which ``ok`` holds, or the smallest with ``high_side``; ok changes once in [0, 1]."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            up = ~ok(mid) if high_side else ok(mid)
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step, lambda s: s["hi"] if high_side else s["lo"])

    found = F.lit(1.0) if entropy is None and repeats is None else F.lit(0.0)
    if entropy is not None:
        found = F.when(reached(F.lit(1.0)), 1.0).otherwise(bisect(reached, False))
    if repeats is not None:
        fits = lambda a: most_used(a) <= F.lit(float(repeats))
        found = F.greatest(found, F.when(fits(F.lit(0.0)), 0.0).otherwise(bisect(fits, True)))
    fitted = whole.select(found.alias("exponent"), "p", "total")
    norm = fitted.select("exponent", "total", mass(F.col("exponent")).alias("mass"), F.array_max("p").alias("largest"))
    weight = F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("mass")
    spent = F.lit(float(budget)) if budget is not None else F.col("total") * F.pow(F.col("largest"), 1 - F.col("exponent")) * F.col("mass")
    # one row on the right
    return shares.crossJoin(F.broadcast(norm)).select(
        "source", "tokens", "rows", "exponent", weight.alias("weight"), F.round(weight * spent / F.col("tokens"), 9).alias("quota"))


def mix(docs: DataFrame, *, entropy: float | None = None, repeats: float | None = None, budget: int | None = None, seed: int = 17) -> DataFrame:
    """row (a struct of ``docs``' columns), tokens, weight, block, place (the block's in its source's order), uses: how often
    the row is used."""
    rows = docs.select(F.struct("*").alias("row"))
    sized = rows.select("row", F.col("row.source").alias("source"), token_count(F.col("row.text")).alias("n"), keyed_hash(seed, F.col("row.doc_id")).alias("hash"))
    totals = sized.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    weights = written(source_weights(written(totals, "mix-totals"), entropy=entropy, repeats=repeats, budget=budget), "mix-weights")
    blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long")
    plan = weights.select(F.col("source").alias("own"), "weight", "quota", "tokens", blocks.alias("blocks"))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_BLOCKS else plan
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("own"))).withColumn("block", F.pmod("hash", "blocks"))
    by_block = joined.groupBy("own", "block").agg(F.sum("n").alias("block_tokens"), F.first("quota").alias("quota"), F.first("tokens").alias("tokens"))
    order = Window.partitionBy("own").orderBy(keyed_hash(seed + 1, F.col("own"), F.col("block")), "block")
    rest = (F.col("quota") - F.floor("quota")) * F.col("tokens")
    before = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens")
    table = written(by_block.select(
        F.col("own").alias("of"), F.col("block").alias("at"), F.row_number().over(order).cast("long").alias("place"),
        F.floor("quota").cast("long").alias("whole"), (rest - before).alias("room"), "block_tokens"), "mix-blocks")
    right = F.broadcast(table) if table.count() <= BROADCAST_BLOCKS else table
    placed = joined.join(right, F.col("own").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    # a source has one block at most that is used in part: of its rows, in a keyed order, those up to the last that fits; only
    # their ids, sizes and hashes are sorted
    partial = (F.col("room") > 0) & (F.col("room") < F.col("block_tokens"))
    key = F.struct(keyed_hash(seed + 2, F.col("row.doc_id")).alias("hash"), F.col("row.doc_id").alias("id"))
    narrow = placed.filter(partial).select("own", "room", "n", key.alias("key"))
    upto = F.sum("n").over(Window.partitionBy("own").orderBy("key"))  # rows of one key are used together
    last = narrow.select("own", "room", "key", upto.alias("upto")).filter("upto <= room").groupBy("own").agg(F.max("key").alias("last"))
    last = written(last.select(F.col("own").alias("cut_of"), "last"), "mix-cuts")
    # a row per source
    cut = placed.join(F.broadcast(last) if last.count() <= BROADCAST_BLOCKS else last, F.col("own").eqNullSafe(F.col("cut_of")), "left")
    more = F.when(partial, F.coalesce(key <= F.col("last"), F.lit(False))).otherwise(F.col("room") > 0).cast("long")
    return cut.select("row", F.col("n").alias("tokens"), "weight", "block", "place", (F.col("whole") + more).alias("uses"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, every row as often as the mix uses it."""
    used = mix(docs, **options)
    times = F.when(F.col("uses") > 0, F.sequence(F.lit(1), F.col("uses").cast("int"))).otherwise(F.array().cast("array<int>"))
    return used.select("row", F.explode(times).alias("epoch")).select(*(F.col(f"row.{c}") for c in fields(docs)))


#: Production parameters of the query: 0.95 of the largest entropy, each source at most 4 times.
ENTROPY, REPEATS = 0.95, 4.0


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, entropy=ENTROPY, repeats=REPEATS).select(
        "row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "block", "place", "uses")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))) AS n,
  ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS rows FROM d GROUP BY source),
p AS (SELECT source, tokens / (SELECT sum(tokens) FROM s) AS p FROM s),
e(k, lo, hi, rlo, rhi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN h >= g THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= g THEN hi ELSE (lo + hi) / 2 END,
         CASE WHEN u > {REPEATS} THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN u > {REPEATS} THEN rhi ELSE (rlo + rhi) / 2 END
  FROM (SELECT k, lo, hi, rlo, rhi, {ENTROPY} * ln(count(*)) AS g, ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS h,
               pow(min(p) / max(p), (rlo + rhi) / 2 - 1) AS u FROM e, p WHERE k < {_STEPS} GROUP BY k, lo, hi, rlo, rhi)),
a AS (SELECT greatest(CASE WHEN (SELECT -sum(p * ln(p)) >= {ENTROPY} * ln(count(*)) FROM p) THEN 1 ELSE lo END, CASE WHEN (SELECT max(p) / min(p) <= {REPEATS} FROM p) THEN 0 ELSE rhi END) AS a FROM e WHERE k = {_STEPS}),
w AS (SELECT s.source, tokens, rows, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, a) AS weight,
             round(pow(p, a - 1) * (SELECT pow(max(p), 1 - a) FROM p, a GROUP BY a), 9) AS quota, least({MOST_BLOCKS}, ceil(rows / {BLOCK_ROWS}))::BIGINT AS blocks FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source, a),
r AS (SELECT d.*, w.weight, w.quota, w.tokens, h % blocks AS block FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
b AS (SELECT source, block, sum(n) AS bn, any_value(quota) AS quota, any_value(tokens) AS tokens,
             ('0x' || substr(md5('18|' || coalesce(source, '') || '|' || block), 1, 8))::BIGINT AS key FROM r GROUP BY source, block),
o AS (SELECT *, row_number() OVER x AS place, (quota - floor(quota)) * tokens - (sum(bn) OVER (x ROWS UNBOUNDED PRECEDING) - bn) AS room FROM b WINDOW x AS (PARTITION BY source ORDER BY key, block)),
f AS (SELECT r.doc_id, r.source, r.n, r.weight, r.block, o.place, o.quota, o.room, o.bn,
             sum(r.n) OVER (PARTITION BY r.source, r.block ORDER BY ('0x' || substr(md5('19|' || coalesce(r.doc_id::VARCHAR, '')), 1, 8))::BIGINT, r.doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r JOIN o ON o.source IS NOT DISTINCT FROM r.source AND o.block = r.block)
SELECT doc_id, source, n::BIGINT AS n_tokens, round(weight, 9) AS weight, block, place,
       floor(quota)::BIGINT + CASE WHEN room <= 0 THEN 0 WHEN room >= bn OR upto <= room THEN 1 ELSE 0 END AS uses FROM f
"""
