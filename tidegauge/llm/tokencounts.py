"""Operator 2, token counts: the exact count at every prefix by dynamic programming, stored, without re-encoding.

A text is split into pieces; the count at a piece boundary is the count at the boundary before it plus the piece's own,
and inside a piece the count of every prefix follows from its shorter prefixes (`bpe.PrefixTable`, whose rows distinct
pieces share).  The counts at all prefixes of whole characters are stored with each row (`pack`); the last one is the
text's count, and any of them (`count_at`) or the longest prefix within a budget (`longest_prefix`) is read off them.
Counts may fall where a prefix grows, as more characters can merge into fewer tokens.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special tokens' strings in a text count as the tokenizer's
file says (one token each, from their last character on); repeated rows give repeated results; an empty table gives an empty
one; other columns of the input are ignored.  Very long texts are handled whole, by one task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import wordbytes as wb
from .common import bounded_batches, read, released, tokenizer_path

#: Token budgets whose longest prefixes are returned.
BUDGETS = (128, 512, 2048, 8192)


def pack(counts: np.ndarray) -> bytes:
    """Counts at the prefixes of 1, 2, ... characters as differences: a byte of the width, then little-endian integers."""
    steps = np.diff(counts, prepend=0)
    width = 1 if not len(steps) or (steps.min() >= -128 and steps.max() <= 127) else 4
    return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def unpack(table: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(table, f"<i{table[0]}", offset=1), dtype=np.int64)


def count_at(table: bytes, chars: int) -> int:
    """Token count of the first ``chars`` characters, from a stored table."""
    return int(unpack(table)[chars - 1]) if chars else 0


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of ``budget`` tokens at most, from a stored table."""
    fits = np.flatnonzero(unpack(table) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_prefixes(docs: DataFrame, *, path: str | None = None, limit: int = 512, budgets: tuple[int, ...] = BUDGETS, steps: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_tokens, over_limit (more than ``limit``), cut_bytes and, with ``steps``, prefix_tokens.

    cut_bytes has the bytes of the longest prefix within each budget; prefix_tokens is the stored table (`unpack`).
    """
    id_type = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()), T.StructField("cut_bytes", T.ArrayType(T.LongType())),
    ]
    if steps:
        fields.append(T.StructField("prefix_tokens", T.BinaryType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.prefix_table(path or tokenizer_path())
        for batch in batches:
            column = batch.column("text").cast(pa.large_string()).fill_null("")
            odd = np.zeros(len(column), bool)
            for s in tokens.special:
                odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = wb.text_bytes(column)
            for a, b in wb.chunks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                counts = bpe.prefix_counts(d, o, tokens)
                for i in np.flatnonzero(odd[a:b]).tolist():
                    counts[o[i] : o[i + 1]] = bpe.special_prefix_counts(column[a + i].as_py(), tokens)
                last = np.append(counts, 0)[np.maximum(o[1:] - 1, 0)]
                n_bytes = np.diff(o)
                n_tokens = np.where(n_bytes > 0, last, 0)
                ends = np.flatnonzero(np.append(d[1:] & 0xC0 != 0x80, True)[: len(d)])  # where characters end
                at = np.searchsorted(ends, o)
                kept = counts[ends]
                cuts = np.repeat(n_bytes[:, None], len(budgets), axis=1)
                for k, budget in enumerate(budgets):
                    for i in np.flatnonzero(n_tokens > budget).tolist():
                        fits = np.flatnonzero(kept[at[i] : at[i + 1]] <= budget)
                        cuts[i, k] = ends[at[i] + fits[-1]] + 1 - o[i] if len(fits) else 0
                cut = pa.ListArray.from_arrays(np.arange(0, cuts.size + 1, len(budgets), dtype=np.int32) if budgets else np.zeros(b - a + 1, np.int32), pa.array(cuts.ravel()))
                out = [batch.column("doc_id").slice(a, b - a), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), cut]
                if steps:
                    out.append(pa.array([pack(kept[at[i] : at[i + 1]]) for i in range(b - a)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(bounded_batches).mapInArrow(released(count), T.StructType(fields))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefixes(read(spark, sf_dir, "documents"), limit=512)
