"""Whole-batch word splitting on Arrow string buffers with NumPy.

A word is a maximal run of bytes that are digits, ASCII letters (A-Z count as a-z) or >= 0x80, so in
code points it is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.  Texts are never
decoded: the split works on the UTF-8 bytes of many rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is still handled whole.
CHUNK_BYTES = 1 << 19

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _c = _b + 32 if 0x41 <= _b <= 0x5A else _b
    if _c >= 0x80 or 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A:
        _FOLD[_b] = _c
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start, end, row) of every word; words never cross a row's end."""
    folded = _FOLD[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = folded != 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.unique(offsets[1:-1])
    if len(cuts) and len(starts):  # a row's end inside a run of word bytes parts it
        k = np.searchsorted(starts, cuts, side="left") - 1
        hit = (k >= 0) & (cuts < ends[np.maximum(k, 0)])
        if hit.any():
            starts = np.sort(np.concatenate([starts, cuts[hit]]))
            ends = np.sort(np.concatenate([ends, cuts[hit]]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return folded, starts, ends, rows


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; kept for the usual chunk."""
    if _powers and len(_powers[0]) > n:
        return _powers[0][: n + 1], _powers[1][: n + 1]
    size = max(n, CHUNK_BYTES) + 1
    both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    if n <= 2 * CHUNK_BYTES:
        _powers[:] = both
    return both[0][: n + 1], both[1][: n + 1]


def hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in any batch."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(folded)
    powers, back = _power_tables(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.multiply(powers[:n], folded.astype(np.uint64) + np.uint64(1), out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    return mix64((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words' row offsets: row i has words [o[i], o[i+1]))."""
    folded, starts, ends, rows = word_spans(data, offsets)
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    return hashes(folded, starts, ends), np.concatenate([[0], np.cumsum(per_row)])


def shingle_hashes(word: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, row offsets); a row of fewer words, but not none, has one shingle of all of them."""
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate([[0], np.cumsum(made)])
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64), out_at
    acc = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0x100000001B3) + word[k : k + len(acc)] if len(acc) else acc
    full = np.flatnonzero(counts >= width)
    out = np.zeros(out_at[-1], np.uint64)
    if len(full):
        sizes = made[full]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(out_at[full], sizes) + inner] = acc[np.repeat(offsets[full], sizes) + inner]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for w in word[offsets[i] : offsets[i + 1]]:
                h = h * np.uint64(0x100000001B3) + w
        out[out_at[i]] = h
    return mix64(out), out_at
