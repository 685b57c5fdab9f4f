"""Operator 5, chat formatting, in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged under one header; the
pieces are concatenated.  The template::

    <turn role="ROLE">TEXT<next/>TEXT</turn>LF

``&`` and ``<`` in texts and roles become ``&amp;`` and ``&lt;`` (in roles also ``"``), so no control string can occur
inside a text, and reading back is exact.  The loss mask is a list of spans of code points that cover the assistant's
texts and no control string.

One conversation becomes one string and so is held by one task; it can't exceed Spark's limit for a string.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own; turns sort by (turn, role,
text), nulls first, so ties have one order; repeated rows are repeated turns; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Pieces whose places are added up at once.
BLOCK = 64
_END = "</turn>\n"
_NEXT = "<next/>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and length in code points, from 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        same_before = (i > 0) & (F.try_element_at(F.col("turns"), F.when(i > 0, i).otherwise(F.lit(1)))["role"] == t["role"])
        same_after = F.coalesce(F.try_element_at(F.col("turns"), i + 2)["role"] == t["role"], F.lit(False))
        header = F.concat(F.lit('<turn role="'), F.replace(escape(t["role"]), F.lit('"'), F.lit("&quot;")), F.lit('">'))
        return F.struct(
            F.when(same_before, F.lit(_NEXT)).otherwise(header).alias("before"), escape(t["text"]).alias("body"),
            F.when(same_after, F.lit("")).otherwise(F.lit(_END)).alias("after"), (t["role"] == loss_role).alias("loss"),
        )

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    # where each piece begins: within slices of BLOCK pieces, then over the slices, as an array that grows is copied each time
    sized = F.transform("pieces", lambda p: F.struct((F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).cast("long").alias("size"), F.length(p["before"]).cast("long").alias("before"), F.length(p["body"]).cast("long").alias("length"), p["loss"].alias("loss")))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("sized"), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: F.slice("sized", k * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(slices, lambda part: F.aggregate(part, _spans(F.lit(0).cast("long")), _add_span))
    flat = pieces.select("conv_id", formatted.alias("formatted"), sized.alias("sized"))
    cut = flat.select("conv_id", "formatted", inner.alias("parts"))
    base = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0).cast("long"), lambda total, part: total + part["at"]))
    spans = F.flatten(F.zip_with("parts", base, lambda part, at: F.transform(part["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))))
    return cut.select("conv_id", "formatted", spans.alias("loss_spans"))


def _spans(at: Column) -> Column:
    return F.struct(at.alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))


def _add_span(acc: Column, p: Column) -> Column:
    span = F.struct((acc["at"] + p["before"]).alias("start"), p["length"].alias("length"))
    return F.struct((acc["at"] + p["size"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, _END, -1), lambda b: b != "")

    def block(b: Column) -> Column:
        head = F.instr(b, '">')
        role = F.substr(b, F.lit(len('<turn role="') + 1), head - F.lit(len('<turn role="') + 1))
        body = F.substr(b, head + F.lit(2))
        return F.transform(F.split(body, _NEXT, -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    made = format_conversations(rows.unionByName(hard))
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss_text"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, coalesce(lag(role) OVER w = role, false) AS follows, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body,
             replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS head FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN follows THEN 7 ELSE length(head) + 22 END)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
