"""Operator 6, benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each block of documents holds, for every term, its postings (word positions within
the block, ascending).  It is written to the shared folder once.  A query is answered block by block: the offset-adjusted
postings of a window's terms are intersected, rarest term first; phrase matches are exact, and `proximity_matches` finds
terms within a span in any order.

Words: maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z; terms are 64-bit hashes of their bytes.  A
window is 13 consecutive words of an item; an item of fewer words, but not none, is one window.

Queries are sent to the index in blocks of a bounded size; the blocks' hits are merged per row of the index, which is known
by its block's number (written with the postings) and its place there, never by what it holds.

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; items that share an id
count once; a null item_id is written as the empty string; repeated rows give repeated results; an empty index or an empty
benchmark gives rows without hits, or none; other columns are ignored; one very long text is one block by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import bounded_batches, read, released, text_key, without, written

WINDOW = 13
#: Bytes of item texts that go out at once.
QUERY_BYTES = 4 << 20


def build_index(docs: DataFrame) -> DataFrame:
    """A row per block of ``docs`` (doc_id, text): block (its number), ids, keys (hash of the text), word offsets, terms, postings."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, ids array<{id_type}>, keys array<bigint>, words binary, terms binary, firsts binary, gaps binary"
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("key"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column("text"))
            for a, b in wb.chunks(offsets):
                word, at = wb.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.argsort(word, kind="stable")
                inorder = word[order]
                first = np.flatnonzero(np.concatenate([[True], inorder[1:] != inorder[:-1]])) if len(inorder) else np.zeros(0, np.int64)
                gaps = np.diff(order, prepend=0).astype("<i4")
                row = [pa.array([x]) for x in (at.astype("<i8").tobytes(), inorder[first].astype("<u8").tobytes(), first.astype("<i8").tobytes(), gaps.tobytes())]
                lists = [pa.array([batch.column(c).slice(a, b - a).to_pylist()], pa.list_(batch.column(c).type)) for c in ("doc_id", "key")]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, *row], ["block", "ids", "keys", "words", "terms", "firsts", "gaps"])
                block += 1

    return written(source.transform(bounded_batches).mapInArrow(released(build), schema), "postings")


@dataclass
class Block:
    """One block's postings: term k's positions are positions[firsts[k]:firsts[k+1]]; ``keys`` are (term number, position)."""

    words: np.ndarray
    terms: np.ndarray
    firsts: np.ndarray
    positions: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(words: bytes, terms: bytes, firsts: bytes, gaps: bytes) -> Block:
        positions = np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64)
        first = np.append(np.frombuffer(firsts, "<i8"), len(positions))
        number = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return Block(np.frombuffer(words, "<i8"), np.frombuffer(terms, "<u8"), first, positions, (number << 32) + positions)

    def look_up(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, postings) of each wanted term; a term that isn't here has no postings."""
        if not len(self.terms):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        k = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return k, np.where(self.terms[k] == wanted, np.diff(self.firsts)[k], 0)

    def phrases(self, terms: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first position) of every occurrence of each window (row of numbers in ``terms``, -1 beyond its size)."""
        number, count = self.look_up(terms)
        counts = np.where(windows >= 0, count[windows], np.iinfo(np.int64).max)
        there = np.flatnonzero(counts.min(axis=1) > 0)
        if not len(there):
            return there, there
        rank = np.argsort(counts[there], axis=1, kind="stable")
        rare = rank[:, 0]
        chosen = number[windows[there, rare]]
        size = counts[there, rare]
        run = np.repeat(np.arange(len(there)), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = self.positions[self.firsts[chosen][run] + inner] - rare[run]
        keep = start >= 0
        run, start = run[keep], start[keep]
        for step in range(1, windows.shape[1]):
            if not len(run):
                break
            place = rank[run, step]
            query = windows[there[run], place]
            wanted = (number[np.maximum(query, 0)] << 32) + start + place
            found = self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted
            keep = (query < 0) | found
            run, start = run[keep], start[keep]
        window = there[run]
        doc = np.searchsorted(self.words, start, side="right")
        inside = start + sizes[window] <= self.words[np.minimum(doc, len(self.words) - 1)]
        return window[inside], start[inside]


@dataclass
class Queries:
    """Windows of items: terms (distinct), windows (numbers in terms), sizes, and the items that hold each window."""

    terms: np.ndarray
    windows: np.ndarray
    sizes: np.ndarray
    item: np.ndarray
    item_window: np.ndarray
    names: list[str]


def item_queries(rows: list[tuple[str, str]], width: int = WINDOW) -> Queries:
    data, offsets = wb.text_bytes(pa.array([t for _, t in rows], pa.string()))
    word, at = wb.words(data, offsets)
    made, owner, sizes = [], [], []
    for i in range(len(rows)):
        w = word[at[i] : at[i + 1]]
        if not len(w):
            continue
        n = min(width, len(w))
        own = np.zeros((len(w) - n + 1, width), np.uint64)
        own[:, :n] = np.lib.stride_tricks.sliding_window_view(w, n)
        made.append(own)
        owner.append(np.full(len(own), i))
        sizes.append(np.full(len(own), n))
    if not made:
        return Queries(np.zeros(0, np.uint64), np.zeros((0, width), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [n for n, _ in rows])
    every, size = np.concatenate(made), np.concatenate(sizes)
    _, first, which = np.unique(np.column_stack([every, size.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
    size = size[first]
    used = np.arange(width)[None, :] < size[:, None]
    terms = np.unique(every[first][used])
    windows = np.where(used, np.searchsorted(terms, every[first]), -1)
    return Queries(terms, windows, size, np.concatenate(owner), which.ravel(), [n for n, _ in rows])


def _query_blocks(items: DataFrame, width: int) -> Iterator[Queries]:
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // QUERY_BYTES))
    for k in range(parts):
        yield item_queries([(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()], width)


def _hits(index: DataFrame, queries: Queries) -> DataFrame:
    """Per document: doc_id, key, block, place, n_words, n_hit, spans (merged [start, end) of hit words) and items."""
    spark = index.sparkSession
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    sent = spark.sparkContext.broadcast(queries)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        order = np.argsort(q.item_window, kind="stable")
        by_window = np.searchsorted(q.item_window[order], np.arange(len(q.sizes) + 1))
        for batch in batches:
            for k in range(len(batch)):
                block = Block.of(*(batch.column(c)[k].as_py() for c in ("words", "terms", "firsts", "gaps")))
                window, start = block.phrases(q.terms, q.windows, q.sizes)
                words = block.words
                n = len(words) - 1
                change = np.zeros(words[-1] + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + q.sizes[window], -1)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
                doc = np.searchsorted(words, start, side="right") - 1
                spans: list[list[int]] = [[] for _ in range(n)]
                items: list[list[str]] = [[] for _ in range(n)]
                for d in np.unique(doc).tolist():
                    own = doc == d
                    items[d] = sorted({q.names[i] for w in set(window[own].tolist()) for i in q.item[order[by_window[w] : by_window[w + 1]]].tolist()})
                    for s, e in sorted(zip((start[own] - words[d]).tolist(), (start[own] + q.sizes[window[own]] - words[d]).tolist(), strict=True)):
                        if spans[d] and s <= spans[d][-1]:
                            spans[d][-1] = max(e, spans[d][-1])
                        else:
                            spans[d] += [s, e]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, batch.column("keys")[k].values, pa.array([batch.column("block")[k].as_py()] * n, pa.int64()), pa.array(np.arange(n)),
                     pa.array(np.diff(words)), pa.array(hit[words[1:]] - hit[words[:-1]]), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "key", "block", "place", "n_words", "n_hit", "spans", "items"])

    return index.transform(bounded_batches).mapInArrow(released(probe), f"doc_id {id_type}, key long, block long, place long, n_words long, n_hit long, spans array<int>, items array<string>")


def phrase_hits(index: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document of the index: doc_id, key, n_words, n_hit, items (sorted ids of items with occurring windows)."""
    every = [_hits(index, q) for q in _query_blocks(items, width)]
    if len(every) == 1:
        return every[0].select("doc_id", "key", "n_words", "n_hit", "items")
    rows = every[0]
    for x in every[1:]:
        rows = rows.unionByName(x.filter(F.size("spans") > 0))
    pairs = F.expr("transform(sequence(0, cast(size(spans) / 2 as int) - 1), i -> struct(spans[2 * i] as s, spans[2 * i + 1] as e))")
    rows = rows.withColumn("pairs", F.when(F.size("spans") > 0, pairs))
    grouped = rows.groupBy("block", "place", "doc_id", "key", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.expr("aggregate(pairs, struct(0L as n, 0 as upto), (a, p) -> struct(a.n + greatest(0, p.e - greatest(p.s, a.upto)) as n, greatest(a.upto, p.e) as upto), a -> a.n)")
    return grouped.select("doc_id", "key", "n_words", covered.alias("n_hit"), "items")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """`phrase_hits` with n_items and contaminated (hits are at least a twentieth of the words)."""
    hits = phrase_hits(build_index(docs), items, width)
    return hits.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))})


def clean_rows(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows."""
    return without(docs, contamination(docs, items, width).filter("contaminated").select("doc_id", "key"))


def proximity_matches(index: DataFrame, queries: list[tuple[str, str]], span: int) -> DataFrame:
    """(doc_id, query, first word): where all distinct words of a query lie within ``span`` words of one document, any order.

    For each occurrence of the query's rarest word in a block, the nearest window that starts or ends around it is tested.
    """
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    asked = [(name, np.unique(wb.words(*wb.text_bytes(pa.array([text])))[0])) for name, text in queries]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                block = Block.of(*(batch.column(c)[k].as_py() for c in ("words", "terms", "firsts", "gaps")))
                ids = batch.column("ids")[k].values
                for name, terms in asked:
                    number, count = block.look_up(terms)
                    if not len(terms) or (count == 0).any():
                        continue
                    lists = [block.positions[block.firsts[t] : block.firsts[t + 1]] for t in number]
                    starts = np.unique(np.concatenate(lists))  # a covering window starts at one of the words
                    doc = np.searchsorted(block.words, starts, side="right") - 1
                    limit = np.minimum(starts + span, block.words[doc + 1])
                    ok = np.ones(len(starts), bool)
                    for p in lists:
                        at = np.searchsorted(p, starts)
                        ok &= (at < len(p)) & (p[np.minimum(at, len(p) - 1)] < limit)
                    if ok.any():
                        d = doc[ok]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array([name] * len(d)), pa.array(starts[ok] - block.words[d])], ["doc_id", "query", "first_word"])

    return index.transform(bounded_batches).mapInArrow(released(probe), f"doc_id {id_type}, query string, first_word long")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH w AS (SELECT doc_id, i, x[i] AS word FROM (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS x FROM documents) d, unnest(range(1, len(x) + 1)) AS r(i)),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS x FROM benchmark),
q AS (SELECT item_id, array_to_string(x[i : i + least(13, len(x)) - 1], ' ') AS win, least(13, len(x)) AS n FROM b, unnest(range(1, greatest(len(x) - 12, 1) + 1)) AS r(i) WHERE len(x) > 0),
sizes AS (SELECT DISTINCT n FROM q),
dw AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win13, word FROM w, sizes WHERE n = 13),
m AS (SELECT DISTINCT dw.doc_id, dw.i, q.n, q.item_id FROM dw JOIN q ON dw.win13 = q.win AND q.n = 13
      UNION SELECT DISTINCT v.doc_id, v.i, q.n, q.item_id FROM (SELECT d.doc_id, i, n, array_to_string(x[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, list(word ORDER BY i) AS x FROM w GROUP BY doc_id) d, (SELECT n FROM sizes WHERE n < 13) s, unnest(range(1, len(x) - n + 2)) AS r(i)) v JOIN q ON q.n < 13 AND q.n = v.n AND q.win = v.win),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM m GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
