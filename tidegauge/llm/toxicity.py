"""Operator 10, toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

A text is a bag of short strings (segments): its tokens (runs without white space, A-Z and two-byte Latin capitals folded;
over 24 bytes: windows of 24 that overlap by half) and, so that gaps may run over white space, two or three neighbouring tokens
of four bytes at most, or any number of one byte, without what lies between them ("id iot", "i d i o t").  Their kernel counts common subsequences of three word
characters that span six bytes at most, each weighted by ``DECAY`` per byte spanned: an insult with a character put in or a
gap keeps most of them.  Kernels are normalised by each string's own weights.

Labels are of whole texts, so the SVM is a multiple-instance one: a text's margin is the highest of its segments'.  It is
trained on labelled rows outside the held-out fifth, at most about ``SAMPLE`` of each label (by a hash of doc_id).  Witnesses
stand for the toxic texts: the segments that are known to be in more of them (likelihood ratio, with the number of all
segments allowed for; copies and most near copies of a text count once), and one segment of each text that has none of those;
all segments of the other texts are examples of the other side, those that
score highest first.  ``ROUNDS`` times, the SVM is fitted on Nystroem features of witnesses and clean segments, and the highest
segment of each text without a known one becomes its witness; without a positive margin the surest does, for a quarter.  So
no count of rows is needed for a word to be learned: an inflected form seen once is its text's witness if its stem scores.
Each witness is learned with a character and with a gap put in, too.  Landmarks are witnesses, chosen by pivoted Cholesky
(largest weighted residual), and frequent clean segments.  A row's margin is 0 at least and ``MOST`` at most, and a sigmoid of it, fitted on the
same rows, is the score.

With landmarks l, Nystroem features and linear weights, a token's margin is a sum over its subsequences of a value that only
depends on the subsequence, so whole texts are scored by a table lookup for each position and gap.

Defined cases: a null or empty text has no segments and gets the score of margin 0; with no labelled row of either kind the
score is the share of toxic labels, or 0; labels that are null, or of rows without text, aren't learned from; a null doc_id
is neither held out nor learned from; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import svm
from . import wordbytes as wb
from .common import bounded_batches, fields, read, released, written
from .langid import held_out

SAMPLE = 12_000
#: Times that witnesses are chosen anew.
ROUNDS = 4
#: Different witnesses, clean segments, and hard ones of each round that the SVM is fitted on at most (its bounded sample), and landmarks.
WITNESSES, CLEAN, HARD, LANDMARKS = 3000, 4000, 2000, 400
#: Segments that may be known by chance, among all.
CHANCE = 0.05
#: How many times as many toxic labelled texts as others have a known segment, or a witness that is in others, too.
ODDS = 4.0
#: How much a witness with something put in counts, and how many witnesses are varied.
VARIED, VARIED_TOP = 0.5, 600
COST = 100.0
#: Margins beyond this count as this (the SVM asks 1 of an example), so that a varied insult is not far from the plain one.
MOST = 1.5
DECAY = 0.6
_SPAN = 24
#: The character before a token's first one: a stem at a word's start isn't the same inside a word.
_START = 1
#: (first gap, second gap) of three characters within six bytes.
_GAPS = [(a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 5]
#: Bytes of a token that counts as a part of a word with spaces put in, and how many of them are joined; single bytes are joined without end.
_SHORT, _JOINED = 4, 3


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word characters or 0, white space, offsets) of the rows, each with a space put before it."""
    data = np.insert(data, offsets[:-1], 32)
    offsets = offsets + np.arange(len(offsets))
    f = wb._FOLD[data]
    if len(f) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        f[1:][capital] += 0x20
    return f, (data == 32) | ((data >= 9) & (data <= 13)), offsets


def _segments(space: np.ndarray, offsets: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of tokens; long ones in windows that begin at ``shift``, only windows with ``shift``."""
    n = len(space)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row_start = np.zeros(n, bool)
    row_start[offsets[:-1][offsets[:-1] < n]] = True
    begins = ~space & (row_start | np.concatenate([[True], space[:-1]]))
    ends = ~space & np.concatenate([space[1:] | row_start[1:], [True]])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start > _SPAN
    if not long.any():
        return (start, end) if not shift else (start[:0], end[:0])
    size = (end - start)[long] - shift
    parts = -(-size // _SPAN)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    s = np.repeat(start[long] + shift, parts) + inner * _SPAN
    e = np.minimum(s + _SPAN, np.repeat(end[long], parts))
    if shift:
        return s, e
    s, e = np.concatenate([start[~long], s]), np.concatenate([end[~long], e])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _views(data: np.ndarray, offsets: np.ndarray):
    """All segments, twice (bytes, start, end, row): the tokens in place, then, copied one after the other, the windows of long
    tokens shifted by half and the word characters of runs of short tokens in windows.  What begins like a token has ``_START`` first."""
    f, space, offsets = _folded(data, offsets)
    start, end = _segments(space, offsets, 0)
    row = np.searchsorted(offsets, start, side="right") - 1
    first_part = space[start - 1]  # not a further window of a long token
    f[start[first_part] - 1] = _START
    yield f, start - first_part, end, row
    s2, e2 = _segments(space, offsets, _SPAN // 2)
    source, size, owner = [_ranges(s2, e2 - s2)], [e2 - s2], [np.searchsorted(offsets, s2, side="right") - 1]
    kept = np.concatenate([[0], np.cumsum(f > _START)])  # word characters before each byte
    at = np.flatnonzero(f > _START)

    def joined(first: np.ndarray, last: np.ndarray) -> None:
        a, b = kept[start[first]], kept[end[last]]
        windows = np.maximum(1, -(-(b - a - _SPAN) // (_SPAN // 2)) + 1)
        number = _ranges(np.zeros(len(windows), np.int64), windows)
        w0 = np.repeat(a, windows) + number * (_SPAN // 2)
        w1 = np.minimum(w0 + _SPAN, np.repeat(b, windows))
        head = np.flatnonzero(number == 0)
        length = w1 - w0
        source.append(np.insert(at[_ranges(w0, length)], (np.cumsum(length) - length)[head], start[first] - 1))
        length[head] += 1
        size.append(length)
        owner.append(np.repeat(row[first], windows))

    size_of = end - start
    whole = first_part & np.append(first_part[1:], True)  # tokens of one part
    alone = (size_of == 1) & whole
    alone = alone[:-1] & alone[1:] & (row[:-1] == row[1:])
    if alone.any():
        before, after = np.append(False, alone), np.append(alone, False)
        joined(np.flatnonzero(after & ~before), np.flatnonzero(before & ~after))
    chain = np.ones(len(start), bool)
    short = (size_of <= _SHORT) & whole
    for more in range(1, min(_JOINED, len(start))):
        n = len(start) - more
        chain = chain[:n] & short[:n] & short[more:] & (row[:n] == row[more:])
        first = np.flatnonzero(chain)
        joined(first, first + more)
    lengths = np.concatenate(size)
    if len(lengths):
        ends = np.cumsum(lengths)
        yield f[np.concatenate(source)], ends - lengths, ends, np.concatenate(owner)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _subsequences(f: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each pair of gaps: (positions, codes, weight) of the three-character subsequences inside one segment."""
    n = len(f)
    token = np.zeros(n + 8, np.int32)
    mark = np.zeros(n + 9, np.int32)
    np.add.at(mark, start, 1)
    inside = np.zeros(n + 9, np.int32)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    token = np.where(np.cumsum(inside[: n + 8]) > 0, np.cumsum(mark[: n + 8]), 0)
    c = np.concatenate([f, np.zeros(8, np.uint8)]).astype(np.int32)
    token[: n + 8][c == 0] = 0  # what isn't a word character can be skipped, not matched
    t0, c0 = token[:n], c[:n]
    for a, b in _GAPS:
        ok = np.flatnonzero((t0 > 0) & (token[a : n + a] == t0) & (token[a + b : n + a + b] == t0))
        yield ok, (c0[ok] << 16) | (c[ok + a] << 8) | c[ok + a + b], DECAY ** (a + b + 1)


def segment_features(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised features of folded segments: (number, code, weight), and which have any."""
    size = np.array([len(t) for t in segments], np.int64)
    start = np.cumsum(size) - size
    owner, code, weight = [], [], []
    for at, codes, w in _subsequences(np.frombuffer(b"".join(segments), np.uint8), start, start + size):
        owner.append(np.searchsorted(start, at, side="right") - 1)
        code.append(codes)
        weight.append(np.full(len(at), w))
    owner, code, weight = np.concatenate(owner), np.concatenate(code), np.concatenate(weight)
    own = np.sqrt(np.bincount(owner, weight**2, len(segments)))
    return owner, code, weight / own[owner], own > 0


def _kernel(x, y, n: int, m: int) -> np.ndarray:
    """Kernel matrix of two sets of sparse features, in blocks of rows of the first (whose owners ascend)."""
    codes = np.unique(y[1])
    if not len(codes):
        return np.zeros((n, m))

    def dense(z, first: int, rows: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(codes, z[1]), len(codes) - 1)
        ok = (codes[at] == z[1]) & (z[0] >= first) & (z[0] < first + rows)
        return np.bincount((z[0][ok] - first) * len(codes) + at[ok], z[2][ok], rows * len(codes)).reshape(rows, len(codes))

    right = dense(y, 0, m).T
    return np.concatenate([dense(x, k, min(500, n - k)) @ right for k in range(0, n, 500)])


@dataclass
class Model:
    """Values of subsequences, the bias of token margins, and the sigmoid of a row's margin."""

    codes: np.ndarray
    values: np.ndarray
    bias: float
    slope: float
    shift: float

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        number = np.zeros(1 << 24, np.uint16)
        number[self.codes] = np.arange(1, len(self.codes) + 1)
        return number, np.concatenate([[0.0], self.values])

    def margins(self, f: np.ndarray, start: np.ndarray, end: np.ndarray, tables) -> np.ndarray:
        """The margin of each segment of folded bytes; 0 without a subsequence."""
        number, values = tables
        value, own = np.zeros(len(f) + 1), np.zeros(len(f) + 1)
        for at, codes, w in _subsequences(f, start, end):
            k = number[codes]
            hit = k > 0
            value[at[hit]] += w * values[k[hit]]
            own[at] += w * w
        upto, norm = np.concatenate([[0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(own)])
        square = norm[end] - norm[start]
        out = np.zeros(len(start))
        some = square > 1e-9
        out[some] = (upto[end] - upto[start])[some] / np.sqrt(square[some]) + self.bias
        return out

    def row_margins(self, data: np.ndarray, offsets: np.ndarray, tables) -> np.ndarray:
        """The highest margin of each row's segments, 0 to MOST."""
        best = np.zeros(len(offsets) - 1)
        for f, start, end, row in _views(data, offsets):
            np.maximum.at(best, row, self.margins(f, start, end, tables))
        return np.minimum(best, MOST)


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column of margins; reads and drops _tox_text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tables = m.table()
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column(batch.num_columns - 1))
            for i, j in wb.chunks(offsets):
                found = m.row_margins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)), pa.array(found)], [*batch.schema.names[:-1], name])

    fields = [f for f in docs.schema.fields if f.name != "_tox_text"]
    return docs.select(*(f.name for f in fields), "_tox_text").transform(bounded_batches).mapInArrow(released(score), T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def _sketched(rows: DataFrame) -> DataFrame:
    """``rows`` (row, label, text) with the smallest hash of a run of five words: copies and most near copies share it."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column("text"))
            for i, j in wb.chunks(offsets):
                run, at = wb.shingle_hashes(*wb.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), 5)
                least = np.zeros(j - i, np.uint64)
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    least[some] = np.minimum.reduceat(run, at[some])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("row", "label", "text")), pa.array(least.astype(np.int64))], ["row", "label", "text", "sketch"])

    return rows.select("row", "label", "text").transform(bounded_batches).mapInArrow(released(sketch), "row long, label int, text string, sketch long")


def _segment_rows(rows: DataFrame) -> DataFrame:
    """(row, label, token): the distinct folded segments of each row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column("text"))
            for i, j in wb.chunks(offsets):
                found: set[tuple[int, bytes]] = set()
                for f, start, end, row in _views(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    raw = f.tobytes()
                    found |= {(r, raw[a:b].strip(b"\0")) for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)}
                some = sorted(x for x in found if len(x[1]) >= 4)
                at = np.array([r for r, _ in some], np.int64) + i
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.array([t for _, t in some], pa.binary())], ["row", "label", "token"])

    return rows.select("row", "label", "text").transform(bounded_batches).mapInArrow(released(cut), "row long, label int, token binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) without the rows held out."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"), 5, 0))
    counts = {int(k): n for k, n in marks.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    flat = Model(np.zeros(0, np.int64), np.zeros(0), -1.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(counts) < 2:
        return flat
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = [int(min(1.0, sample / counts[k]) * (1 << 30)) for k in (0, 1)]
    chosen = marks.select("doc_id", (F.col("toxic") > 0).cast("int").alias("label")).filter(at < F.when(F.col("label") == 1, limit[1]).otherwise(limit[0]))
    # about 2 * sample rows of labels
    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("row"), "label", F.col("text").cast("string").alias("text"))
    rows = written(_sketched(rows), "toxic-sample")
    rows = rows.join(rows.groupBy("label", "sketch").agg(F.min("row").alias("row")).select("row").distinct(), "row")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count_distinct("row").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return flat
    pairs = written(_segment_rows(rows).distinct(), "toxic-segments")
    table = pairs.groupBy("token").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    rate = F.log((F.col("pos") + 0.1) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    table = written(table.select("token", "pos", "neg", rate.alias("rate")), "toxic-counts")
    ratio_of = math.log(ODDS * counts[0] / counts[1])
    part, least = n_pos / (n_pos + n_neg), math.log(max(table.count(), 1) / CHANCE)
    pos, neg = F.col("pos"), F.col("neg")
    ratio = lambda x, expected: F.when(x > 0, x * F.log(x / ((pos + neg) * expected))).otherwise(0.0)
    table = table.withColumn("sure", ratio(pos, part) + ratio(neg, 1 - part))
    toxic = pairs.filter("label = 1").select("row", "token")
    certain = table.filter((F.col("sure") > least) & (F.col("rate") > ratio_of)).orderBy(F.desc("sure"), "token").limit(WITNESSES).select("token", "pos").collect()
    known = {bytes(r.token): float(r.pos) for r in certain}
    names = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in known], "token binary"))
    toxic = written(toxic.join(toxic.join(names, "token").select("row").distinct(), "row", "left_anti"), "toxic-unknown")

    def witnesses(ranked: DataFrame) -> dict[bytes, float]:
        """Rows that each witness stands for: the known ones, and each further row's segment in ``ranked`` of the highest margin, then the surest."""
        of = toxic.join(ranked.select("token", F.struct("margin", "sure").alias("rank")), "token").groupBy("row").agg(F.max(F.struct("rank", "token")).alias("best"))
        count = F.when(F.col("best.rank.margin") > 0, 1.0).otherwise(0.25)
        found = of.groupBy("best.token").agg(F.sum(count).alias("n")).orderBy(F.desc("n"), "token").limit(WITNESSES).collect()
        return {bytes(r.token): r.n for r in found} | known

    standing = witnesses(table.filter(f"rate > {ratio_of} OR neg = 0").withColumn("margin", F.lit(0.0)))
    if not standing:
        return flat
    frequent = table.filter(f"neg > 0 AND rate <= {ratio_of}").orderBy(F.desc("neg"), "token").limit(CLEAN // 2).collect()
    others = table.filter(f"neg > 0 AND rate <= {ratio_of}").orderBy(F.xxhash64("token"), "token").limit(CLEAN // 2).collect()
    clean = dict.fromkeys(bytes(r.token) for r in [*frequent, *others])
    model = _fit(standing, clean)
    for _ in range(ROUNDS):
        margins = written(_margins(table, model).filter(f"margin > 0 OR rate > {ratio_of} OR neg = 0"), "toxic-margins")
        hard = margins.filter(f"neg > 0 AND rate <= {ratio_of}").orderBy(F.desc("margin"), "token").limit(HARD).collect()
        clean |= dict.fromkeys(bytes(r.token) for r in hard)
        standing = witnesses(margins.filter(f"rate > {ratio_of} OR neg = 0"))
        model = _fit(standing, clean)
    got = _scored(rows.select("label", F.col("text").alias("_tox_text")), model, "margin").groupBy("label", F.round("margin", 2).alias("margin")).count().collect()
    margin, label, times = np.array([r.margin for r in got]), np.array([r.label for r in got], float), np.array([r["count"] for r in got])
    model.slope, model.shift = svm.fit_sigmoid(np.repeat(margin, times), np.repeat(label, times))
    return model


def _margins(tokens: DataFrame, model: Model) -> DataFrame:
    """``tokens`` (token, pos, neg, rate, sure) with the margin of each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.table()
        for batch in batches:
            for i in range(0, len(batch), 50_000):
                part = batch.slice(i, 50_000)
                f, offsets = wb.text_bytes(part.column("token").cast(pa.large_binary()).view(pa.large_string()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.margins(f, offsets[:-1], offsets[1:], tables))], [*part.schema.names, "margin"])

    return tokens.transform(bounded_batches).mapInArrow(released(score), T.StructType([*tokens.schema.fields, T.StructField("margin", T.DoubleType())]))


def _pivots(features, weight: np.ndarray, most: int) -> list[int]:
    """Rows that span the features best: pivoted Cholesky of their kernel matrix, by residual times weight."""
    n = len(weight)
    k = _kernel(features, features, n, n)
    rest, rows, out = k.diagonal().copy(), np.zeros((n, min(most, n))), []
    for c in range(rows.shape[1]):
        i = int(np.argmax(rest * weight))
        if rest[i] < 1e-3:
            break
        rows[:, c] = (k[:, i] - rows[:, :c] @ rows[i, :c]) / np.sqrt(rest[i])
        rest = np.maximum(rest - rows[:, c] ** 2, 0)
        out.append(i)
    return out


def _varied(token: bytes) -> list[bytes]:
    """The segment with a gap, and with a character, put in at a place that depends on it."""
    k = 2 + zlib.crc32(token) % max(1, len(token) - 2)
    return [token[:k] + b"\0" + token[k:], token[:k] + token[k - 1 : k] + token[k:], token[:k] + b"x" + token[k:]]


def _fit(standing: dict[bytes, float], others: dict[bytes, None]) -> Model:
    """The SVM on the Nystroem features of the kernels of witnesses (with the rows they stand for) and clean segments."""
    positive, clean = list(standing), [t for t in others if t not in standing]
    weight = np.array([standing[t] for t in positive])
    landmarks = []
    for tokens, worth, most in ((positive[:600], weight[:600], LANDMARKS * 3 // 4), ([*clean[:300], *clean[-300:]], np.ones(min(len(clean), 300) * 2), LANDMARKS // 4)):
        landmarks += [tokens[i] for i in _pivots(segment_features(tokens), worth, most)]
    y = segment_features(landmarks)
    landmarks = [t for t, ok in zip(landmarks, y[3], strict=True) if ok]
    y = segment_features(landmarks)
    m = len(landmarks)
    values, vectors = np.linalg.eigh(_kernel(y, y, m, m))
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    more = {v: w * VARIED for t, w in zip(positive[:VARIED_TOP], weight, strict=False) for v in _varied(t)}
    positive, weight = [*positive, *more], np.concatenate([weight, list(more.values())])
    tokens = [*positive, *clean]
    x = segment_features(tokens)
    features = _kernel(x, y, len(tokens), m) @ root
    label = np.array([1.0] * len(positive) + [-1.0] * len(clean))
    scale = np.concatenate([weight / weight.mean(), np.ones(len(clean))])
    w = svm.fit_newton(features, label, cost=COST, weights=scale)
    beta = root @ w[:-1]
    codes, place = np.unique(y[1], return_inverse=True)
    return Model(codes.astype(np.int64), np.bincount(place, y[2] * beta[y[0]], len(codes)), float(w[-1]), 1.0, 0.0)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted; columns of those names are replaced."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("_tox_text"))
    score = 1 / (1 + F.exp(-(F.col("margin") * F.lit(model.slope) + F.lit(model.shift))))
    found = _scored(rows, model, "margin").select(*(F.col(f"row.{c}") for c in fields(docs, "score", "predicted")), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
