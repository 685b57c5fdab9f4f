"""Operator 4, language ID: the language family first, then one-versus-one linear SVMs within the family.

A text's features are its shares of byte 1-, 2- and 3-grams (A-Z folded, every run of other ASCII characters a space)
in ``BINS`` hashed bins.  Families are told apart by one linear SVM each against the rest; the languages of a family by one
linear SVM for each pair of them, which vote (ties: the larger sum of margins).  The score is the family's calibrated
probability times that of the closest pair that the language won.

Training reads about ``EACH`` labelled rows of each language (fewer with over 16 languages), all where a language has no
more, chosen by a hash of doc_id.

Defined cases: ``und`` with score 0 for a null text and for one without a letter; rows without a language aren't learned
from; with one language, or none, to learn from, every text with a letter gets it, or ``und``; a null doc_id isn't held out
and isn't learned from; repeated rows give repeated results; an empty table gives an empty one; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import svm
from . import wordbytes as wb
from .common import bounded_batches, fields, fresh, read, released

BINS = 1 << 12
#: Labelled rows to learn from (the bounded sample): of each language, where there are up to SAMPLE / EACH of them; then an
#: equal part of SAMPLE, LEAST at least.
EACH, SAMPLE, LEAST = 400, 6400, 20
#: Families of ISO 639-1 codes; any other code is a family by itself.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "indic": "bn gu hi mr ne pa si ur".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "semitic": "am ar he mt".split(),
    "iranian": "fa ku ps tg".split(),
    "sinitic": "zh".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family_of(code: str) -> str:
    return _FAMILY.get(code.lower().replace("_", "-").split("-")[0], code)


def gram_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin of every gram, row offsets of the grams): each kept byte starts a 1-, a 2- and a 3-gram, which may look past its row's end only into spaces."""
    folded = wb._FOLD[data]
    keep = folded != 0
    follows = np.zeros(len(folded), bool)
    follows[1:] = keep[:-1]
    kept = keep | follows
    kept[offsets[:-1][offsets[:-1] < len(data)]] |= True
    at = np.flatnonzero(kept)
    f = np.where(folded[at] == 0, 32, folded[at]).astype(np.uint32)
    rows = np.searchsorted(at, offsets)
    n = len(f)
    end = np.zeros(n + 2, bool)
    end[rows[1:]] = True
    one = np.concatenate([f, np.full(2, 32, np.uint32)])
    second = np.where(end[1 : n + 1], 32, one[1 : n + 1])
    third = np.where(end[1 : n + 1] | end[2 : n + 2], 32, one[2 : n + 2])
    codes = np.stack([f, f | (second << 8) | (1 << 25), f | (second << 8) | (third << 16) | (1 << 26)], axis=1)
    bins = ((codes * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int32)
    return bins.ravel(), rows * 3


@dataclass
class Model:
    """Columns of ``weights``: a margin for each family (if there are several), then one for each pair within a family."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each row."""
        n = len(margins)
        sure = svm.sigmoid(margins * self.slope + self.shift)
        many = len(self.families) > 1
        family = margins[:, : len(self.families)].argmax(axis=1) if many else np.zeros(n, np.int64)
        score = sure[np.arange(n), family] if many else np.ones(n)
        first = len(self.families) if many else 0
        own = np.array([self.families.index(family_of(x)) for x in self.languages])
        votes, sums, least = np.zeros((n, len(self.languages))), np.zeros((n, len(self.languages))), np.ones((n, len(self.languages)))
        for c, (_, i, j) in enumerate(self.pairs, start=first):
            won = margins[:, c] > 0
            votes[:, i] += won
            votes[:, j] += ~won
            sums[:, i] += margins[:, c]
            sums[:, j] -= margins[:, c]
            least[:, i] = np.minimum(least[:, i], sure[:, c])
            least[:, j] = np.minimum(least[:, j], 1 - sure[:, c])
        votes = np.where(own[None, :] == family[:, None], votes + 1e-6 * np.tanh(sums), -1)
        best = votes.argmax(axis=1)
        return best, np.clip(score * least[np.arange(n), best], 0, 1)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, each: int = EACH) -> Model | None:
    """A model of ``docs`` (doc_id, text, lang) without the rows held out; None if no row has a language and a letter."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    each = max(LEAST, min(each, SAMPLE // len(counts)))
    wanted = F.lit(False)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    for lang, n in sorted(counts.items()):
        wanted |= (F.col("lang") == lang) & (at < int(min(1.0, each / n) * (1 << 30)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wb.text_bytes(batch.column("text"))
            for i, j in wb.chunks(offsets):
                bins, rows = gram_bins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                made = [(np.bincount(bins[a:b], minlength=BINS) / max(1, b - a) * 100).astype("<f4").tobytes() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array(made, pa.binary())], ["lang", "x"])

    # about ``each`` rows of 16 KB for each language
    got = rows.filter(wanted).select("lang", F.col("text").cast("string").alias("text")).transform(bounded_batches).mapInArrow(released(features), "lang string, x binary").collect()
    if not got:
        return None
    x = np.stack([np.frombuffer(r.x, "<f4") for r in got])
    lang = np.array([r.lang for r in got])
    order = np.lexsort((x[:, 0], lang))
    x, lang = x[order], lang[order]
    languages = sorted(set(lang.tolist()))
    families = sorted({family_of(c) for c in languages})
    family = np.array([family_of(c) for c in lang])
    columns, calibrations, pairs = [], [], []

    def add(rows: np.ndarray, positive: np.ndarray) -> None:
        w = svm.fit_linear(x[rows], np.where(positive, 1.0, -1.0), cost=10.0)
        columns.append(w)
        calibrations.append(svm.fit_sigmoid(x[rows] @ w[:-1] + w[-1], positive.astype(float)))

    everything = np.ones(len(x), bool)
    if len(families) > 1:
        for f in families:
            add(everything, family == f)
    for k, f in enumerate(families):
        for i, j in combinations([n for n, c in enumerate(languages) if family_of(c) == f], 2):
            rows = (lang == languages[i]) | (lang == languages[j])
            add(rows, lang[rows] == languages[i])
            pairs.append((k, i, j))
    w = np.stack(columns) if columns else np.zeros((0, BINS + 1))
    c = np.array(calibrations).reshape(-1, 2)
    return Model(languages, families, pairs, np.ascontiguousarray(w[:, :-1].T * 100).astype(np.float32), w[:, -1], c[:, 0], c[:, 1])


def _lettered(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows have a letter: at once for ASCII, by character for the rest."""
    ascii_letter = (wb._FOLD[data] >= 0x61) & (data < 0x80)
    upto = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(c.isalpha() for c in (column[i].as_py() or ""))
    return found


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and the score, under ``names``; columns of those names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            column = batch.column("text")
            data, offsets = wb.text_bytes(column)
            for i, j in wb.chunks(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                lettered = _lettered(column.slice(i, j - i), d, o)
                name, score = np.full(j - i, "und", object), np.zeros(j - i)
                if m is not None and lettered.any():
                    bins, rows = gram_bins(d, o)
                    margins = np.zeros((j - i, m.weights.shape[1]))
                    some = np.flatnonzero(np.diff(rows))
                    for c in range(m.weights.shape[1]):
                        margins[some, c] = np.add.reduceat(m.weights[:, c][bins], rows[some], dtype=np.float64) / np.diff(rows)[some] + m.bias[c]
                    best, sure = m.predict(margins)
                    name[lettered] = np.array(m.languages, object)[best[lettered]]
                    score[lettered] = sure[lettered]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array(name, pa.string()), pa.array(score)], ["row", "language", "sure"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("language", T.StringType()), T.StructField("sure", T.DoubleType())])
    found = rows.transform(bounded_batches).mapInArrow(released(classify), schema)
    return found.select(*(F.col(f"row.{c}") for c in fields(docs, *names)), F.col("language").alias(names[0]), F.col("sure").alias(names[1]))


def recognised(docs: DataFrame, model: Model | None, least: float = 0.1) -> DataFrame:
    """``docs`` without the rows of no language (``und``) or of a score under ``least``."""
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = identify(docs, model, names)
    return found.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*fields(docs))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
