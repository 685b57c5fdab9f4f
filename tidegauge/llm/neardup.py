"""Operator 8, n-gram Jaccard join: a MinHash LSH forest with exact verification.

Documents are sets of five-word shingles; two are linked at a Jaccard similarity of 0.8 or more.

1. Rows with the same sequence of words are collapsed first (map-side); a text stands for its copies from then on.
2. Each text has ``trees`` labels of ``deepest`` MinHash values: its paths in the forest's prefix tries.  A trie is its labels
   in sorted order (range-partitioned by tree and label, without
   those that share no prefix at all); a node at a depth is a run of labels that share a prefix.
3. The deepest nodes come first: their texts are verified on their whole shingle sets, and the similarities of the links
   found are counted.  A pair at similarity s is met at depth d with probability 1 - (1 - s^d)^trees; while that is under the
   target recall for the lowest similarity found, the matched prefix is shortened by one value.  A shorter prefix is worked
   through only for nodes that join several deeper ones, and for pairs that share no longer prefix anywhere.
4. Nodes with the same members in several trees are verified once, a pair only in its first tree.  A large node is dealt out
   as pairs of tiles of bounded size, so no task holds a node; counts and star edges leave a tile, not pairs.
5. Star edges are joined to connected components by label propagation with pointer jumping.

At the threshold the default target ends at 4 values at the latest (recall 0.9998 there, 0.9999999 at similarity 0.9).

Defined cases: a text of fewer than five words, but at least one, is one shingle of them all; a null or empty text has no
words, links to nothing and is a class by itself; repeated rows link to each other; a null doc_id is grouped like any other
but never names a class if another row can; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import bounded_batches, gathered, read, released, text_key, without, written

WIDTH = 5
THRESHOLD = 0.8
TREES = 16
DEEPEST = 5
RECALL = 0.999
#: Texts, and bytes of shingles, of a tile.
TILE, TILE_BYTES = 512, 8 << 20
#: Rows of tiles that a task verifies at least, where there are more tasks than twice the cores.
TASK_ROWS = 2048
#: Bins of the similarities between the threshold and 1 in which links are counted.
BINS = 20
#: Texts whose shingles are fetched by a broadcast of their keys (of 16 bytes); more are fetched by a shuffle.
BROADCAST_TEXTS = 1_000_000


def met(similarity: float, depth: int, trees: int) -> float:
    """The probability that a pair shares a prefix of ``depth`` values in one tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def estimated_recall(links: dict[float, int], depth: int, trees: int) -> tuple[float, float]:
    """(of all links, of the lowest similarity found) what part has been met at ``depth``; ``links`` are counts by similarity.

    A link that was found stands for 1 / probability links; without any there is nothing to miss.
    """
    if not links:
        return 1.0, 1.0
    there = sum(n / met(s, depth, trees) for s, n in links.items())
    return sum(links.values()) / there, met(min(links), depth, trees)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, count + 1, dtype=np.uint64)
    return wb.mix64(k * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1), wb.mix64(k * np.uint64(0xA0761D6478BD642F))


def signatures(docs: DataFrame, width: int = WIDTH, trees: int = TREES, deepest: int = DEEPEST) -> DataFrame:
    """Per row: doc_id, key (hash of the text), digest of its words (null without words), n_words, signature."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    a, b = _multipliers(trees * deepest)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column("text"))
            for i, j in wb.chunks(offsets):
                word, at = wb.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                shingle, shingle_at = wb.shingle_hashes(word, at, width)
                some = np.flatnonzero(np.diff(at))
                made = np.empty((len(some), len(a)), np.uint32)
                if len(some):
                    firsts = shingle_at[some]
                    for k in range(len(a)):
                        made[:, k] = np.minimum.reduceat(((shingle * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), firsts)
                digest: list[bytes | None] = [None] * (j - i)
                signature: list[bytes | None] = [None] * (j - i)
                for r, s in zip(some.tolist(), made, strict=True):
                    digest[r] = hashlib.blake2b(word[at[r] : at[r + 1]].tobytes(), digest_size=16).digest()
                    signature[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("key").slice(i, j - i), pa.array(digest, pa.binary()), pa.array(np.diff(at)), pa.array(signature, pa.binary())], ["doc_id", "key", "digest", "n_words", "signature"])

    return source.transform(bounded_batches).mapInArrow(released(sign), f"doc_id {id_type}, key bigint, digest binary, n_words bigint, signature binary")


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """digest and sorted distinct shingles of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column("text"))
            for i, j in wb.chunks(offsets):
                word, at = wb.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                shingle, shingle_at = wb.shingle_hashes(word, at, width)
                digest = [hashlib.blake2b(word[at[r] : at[r + 1]].tobytes(), digest_size=16).digest() for r in range(j - i)]
                sets = [np.unique(shingle[shingle_at[r] : shingle_at[r + 1]]).astype("<u8").tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return docs.transform(bounded_batches).mapInArrow(released(cut), "digest binary, shingles binary")


def _intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs."""
    if len(rows) <= 4 * len(sets):
        out = np.empty(len(rows), np.int64)
        for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)):
            small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            out[k] = np.count_nonzero(large[at] == small)
        return out
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.flatnonzero(count == len(sets))
    shared = np.flatnonzero((count > 1) & (count < len(sets)))
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[term]
    kept = column >= 0
    owner, column = owner[kept], column[kept]
    total = np.full((len(sets), len(sets)), float(len(every)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((len(sets), min(4096, len(shared) - first)), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        total += block @ block.T
    return total[rows, cols].astype(np.int64)


def _verified(tiles: DataFrame, trees: int, deepest: int, depth: int, threshold: float) -> DataFrame:
    """Per tile and text with a link in it: digest, root (smallest digest it is linked with there), links (rows), texts.

    And, without a digest, the tile's links by bin of their similarity: bin, texts (links).
    """

    def one(tree: int, part: np.ndarray, digest: list[bytes], copies: np.ndarray, signature: np.ndarray, raw: list[bytes]):
        n = len(digest)
        i, j = np.triu_indices(n, 1)
        if part.min() != part.max():
            cross = part[i] != part[j]
            i, j = i[cross], j[cross]
        whole = signature.reshape(n, trees, deepest)
        labels = whole[:, :, :depth]
        for t in range(trees):  # a pair counts in its first tree, at its longest prefix
            upto = depth if t < tree else depth + 1
            if not len(i) or upto > deepest:
                break
            new = (whole[i, t, :upto] != whole[j, t, :upto]).any(axis=1)
            i, j = i[new], j[new]
        if not len(i):
            return None
        same = (labels[i, tree] == labels[j, tree]).all(axis=1)
        i, j = i[same], j[same]
        sets = [np.frombuffer(x, "<u8") for x in raw]
        size = np.array([len(s) for s in sets])
        fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        if not len(i):
            return None
        common = _intersections(sets, i, j)
        linked = common >= threshold * (size[i] + size[j] - common) - 1e-9
        i, j, common = i[linked], j[linked], common[linked]
        if not len(i):
            return None
        alike = common / (size[i] + size[j] - common)
        seen = np.bincount(np.clip((alike - threshold) / (1 - threshold) * BINS, 0, BINS - 1).astype(int) if threshold < 1 else np.zeros(len(i), int), minlength=BINS)
        links, texts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x, y in ((i, j), (j, i)):
            np.add.at(links, x, copies[y])
            np.add.at(texts, x, 1)
        root = np.arange(n)  # rows are sorted by digest, so the smallest number is the smallest digest
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        own = np.flatnonzero(texts)
        bins = np.flatnonzero(seen)
        none: list[None] = [None] * len(bins)
        return [
            pa.array([*(digest[k] for k in own), *none], pa.binary()), pa.array([*(digest[root[k]] for k in own), *none], pa.binary()), pa.array([*links[own].tolist(), *none], pa.int64()),
            pa.array(np.concatenate([texts[own], seen[bins]])), pa.array([*[None] * len(own), *bins.tolist()], pa.int32()),
        ]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, seen = None, [], set()

        def flush():
            if at is None or len(rows) < 2:
                return None
            rows.sort(key=lambda r: r[1])
            return one(at[0], np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(len(rows), -1), [r[4] for r in rows])

        def batch_of(found):
            return pa.RecordBatch.from_arrays(found, ["digest", "root", "links", "texts", "bin"])

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("tree", "node", "low", "high", "part", "digest", "copies", "signature", "shingles")]
            for tree, node, low, high, part, digest, copies, signature, shingles in zip(*names, strict=True):
                if at != (tree, node, low, high):
                    if found := flush():
                        yield batch_of(found)
                    at, rows, seen = (tree, node, low, high), [], set()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((part, digest, copies, signature, shingles))
        if found := flush():
            yield batch_of(found)

    dealt = tiles.repartition("tree", "node", "low", "high").sortWithinPartitions("tree", "node", "low", "high")
    return dealt.select("tree", "node", "low", "high", "part", "digest", "copies", "signature", "shingles").transform(bounded_batches).mapInArrow(released(verify), "digest binary, root binary, links bigint, texts bigint, bin int")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component; ``edges`` has u and v."""
    most = 2 * edges.count()
    both = written(gathered(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct(), most), "edges")
    labels = written(gathered(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumnRenamed("u", "node"), most), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = written(gathered(low.join(jump, low["label"] == jump["at"]).select("node", "old", F.least("label", "further").alias("label")), most), "labels")
        if not labels.filter("old <> label").limit(1).count():
            return labels.select("node", "label")


def _level(docs: DataFrame, texts: DataFrame, forest: DataFrame, most: int, depth: int, width: int, threshold: float, trees: int, deepest: int) -> DataFrame:
    """`_verified` tiles of the nodes at ``depth`` whose pairs haven't all been met deeper down; ``forest`` has ``most`` rows at most."""
    upto = lambda d: F.xxhash64(F.substring("label", 1, 4 * d))
    placed = forest.select("digest", "n_words", "tree", upto(depth).alias("node"), upto(depth + 1).alias("child"))
    nodes = placed.groupBy("tree", "node").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("words"), F.bit_xor(F.xxhash64("digest")).alias("members"), (F.min("child") < F.max("child")).alias("joins")).filter("n > 1")
    once = nodes.groupBy("n", "words", "members").agg(F.min(F.struct("tree", "node")).alias("at"), F.min("joins").alias("joins"))
    once = once if depth == deepest else once.filter("joins")
    parts = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("words") * 8 / TILE_BYTES)).cast("int")
    held = written(gathered(placed.select("tree", "node", "digest").join(once.select("at.tree", "at.node", parts.alias("parts")), ["tree", "node"]), most), "trie-nodes")
    members, dealt_rows = held.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
    wanted = held.select("digest").distinct().join(texts, "digest").select("digest", "copies", "signature", "doc_id", "key")
    wanted = written(gathered(wanted, members), "wanted")
    keys = wanted.select(F.col("doc_id").alias("w_id"), F.col("key").alias("w_key"))
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_TEXTS else keys
    texts_of = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = texts_of.join(keys, texts_of["doc_id"].eqNullSafe(keys["w_id"]) & (F.xxhash64("text") == F.col("w_key")), "left_semi").select("text")
    sets = _shingle_sets(chosen, width)
    mine = F.pmod(F.xxhash64("digest"), "parts").cast("int")
    dealt = held.withColumn("part", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("tree", "node", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "digest")
    tiles = dealt.join(wanted.select("digest", "copies", "signature"), "digest").join(sets, "digest")
    return written(gathered(_verified(tiles, trees, deepest, depth, threshold), dealt_rows, TASK_ROWS), "stars")


def near_duplicates(
    docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, report: dict | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id (smallest doc_id of its class), class_size, n_links (rows it is
    linked with, copies included), n_texts (different texts it is linked with); key and keep_key are the hashes of the row's
    text and of the class's smallest row's.  ``report`` gets the depth reached, the links by similarity and the estimated recall."""
    signed = written(signatures(docs, width, trees, deepest), "signatures")
    rows = signed.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    texts = written(gathered(
        signed.filter("digest IS NOT NULL").groupBy("digest")
        .agg(F.count("*").alias("copies"), first.alias("first"), F.first("n_words").alias("n_words"), F.first("signature").alias("signature"))
        .select("digest", "copies", "first.doc_id", "first.key", "n_words", "signature"), rows), "texts")
    paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substr(F.col("signature"), t * (deepest * 4) + 1, F.lit(deepest * 4)))
    leaves = texts.select("digest", "n_words", F.posexplode(paths).alias("tree", "label"))
    # no prefix is shortened beyond this one, so a label that shares it with no other is in no node
    shallowest = next((d for d in range(deepest, 1, -1) if met(threshold, d, trees) >= recall), 1)
    rooted = leaves.withColumn("root", F.xxhash64(F.substring("label", 1, 4 * shallowest)))
    shared = rooted.groupBy("tree", "root").count().filter("count > 1").select("tree", "root")
    forest = rooted.join(shared, ["tree", "root"], "left_semi").drop("root")
    forest = written(gathered(forest.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label"), rows * trees), "forest")
    stars, links = None, {}
    for depth in range(deepest, shallowest - 1, -1):
        found = _level(docs, texts, forest, rows * trees, depth, width, threshold, trees, deepest)
        for r in found.filter("digest IS NULL").groupBy("bin").agg(F.sum("texts").alias("n")).collect():  # BINS rows
            s = threshold + (1 - threshold) * r.bin / BINS
            links[s] = links.get(s, 0) + r.n
        own = found.filter("digest IS NOT NULL").drop("bin")
        stars = own if stars is None else stars.unionByName(own)
        overall, lowest = estimated_recall(links, depth, trees)
        if lowest >= recall:
            break
    if report is not None:
        report.update(depth=depth, links=links, recall=overall, recall_of_lowest=lowest)
    labels = components(stars.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    counted = stars.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    base = texts.select("digest", "copies", "doc_id", "key")
    joined = labels.withColumnRenamed("node", "digest").join(base, "digest")
    groups = joined.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("keep"), F.sum("copies").alias("class_size"))
    linked = joined.select("digest", "label").join(groups, "label").join(counted, "digest").select("digest", "keep", "class_size", "links", "texts")
    settled = base.join(linked, "digest", "left").select(
        F.col("digest").alias("d"), F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"), F.coalesce("keep.key", "key").alias("keep_key"), F.coalesce("class_size", "copies").alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))
    settled = written(gathered(settled, rows), "classes")
    some = signed.filter("digest IS NOT NULL").select("doc_id", "digest", "key")
    out = some.join(settled, F.col("digest") == F.col("d")).select("doc_id", "class_id", "class_size", "n_links", "n_texts", "key", "keep_key")
    none = signed.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"), "key", F.col("key").alias("keep_key"))
    return gathered(out.union(none), rows)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the one that names it; of repeated rows, one."""
    found = written(near_duplicates(docs, **options), "near-classes")
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("key").eqNullSafe(F.col("keep_key"))
    rest = without(docs, found.filter(~keeps))
    twice = written(found.filter(keeps & (F.col("class_size") > 1)).groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key"), "repeated")
    if not twice.limit(1).count():
        return rest
    rows = rest.select(F.struct("*").alias("row"))
    again = rows.join(twice, rows["row.doc_id"].eqNullSafe(twice["doc_id"]) & (text_key(rows["row.text"]) == twice["key"]))
    first = again.groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*")
    return without(rest, twice).unionByName(first)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("key", "keep_key")
