"""Byte-level BPE over Arrow batches: vectorised piece splitting, a piece cache and prefix dynamic programming.

Texts split into pieces by the byte-level pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; NumPy finds the piece
boundaries of many rows at once on their UTF-8 bytes, and each distinct piece is encoded once per worker.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import wordbytes as wb

#: White space of the pattern's ``\s``.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Pieces kept by a worker before the cache starts anew; a chunk with more distinct ones (a very long text) has a larger table.
CACHE_PIECES = 1 << 19
#: Pieces encoded at once.
_ENCODED = 1 << 16


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for mark, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = mark
    table[0xD800:0xE000] = _OTHER
    table[_SPACES] = _SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte's character."""
    table = _classes()
    out = table[:256][data].copy()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
        two = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
        three = ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
        four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
        point = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        mark = table[np.minimum(point, 0x10FFFF)]
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        for k in range(4):
            own = size > k
            at = lead[own] + k
            ok = at < len(out)
            out[at[ok]] = mark[own][ok]
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
    """Byte positions at which a piece starts; every row's first byte is one.  ``kind``: `byte_classes`, if known."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data) if kind is None else kind
    row_start = np.zeros(n + 1, bool)
    row_start[offsets[:-1][offsets[:-1] < n]] = True
    row_start[n] = True
    start = row_start[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    lead = (data & 0xC0) != 0x80
    after = np.ones(n, np.uint8) * 255  # class of the next character's first byte within the row, 255 at its end
    after[:-1] = np.where(row_start[1:-1], 255, kind[1:])
    # the last white-space character before other text starts a piece; a plain space takes the text after it along
    last = np.flatnonzero((kind == _SPACE) & (after != _SPACE) & (after != 255))
    head = last.copy()
    for _ in range(3):
        back = ~lead[head]
        if not back.any():
            break
        head[back] -= 1
    start[head] = True
    plain = data[last] == 0x20
    start[last[plain] + 1] = False
    # 's 't 're 've 'm 'll 'd after anything but a plain space
    mark = np.flatnonzero((data == 0x27) & start & (after == _LETTER))
    if len(mark):
        nxt = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = nxt[mark + 1], nxt[mark + 2]
        inside = ~row_start[np.minimum(mark + 2, n)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = inside & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, width in ((mark[single], 2), (mark[double & ~single], 3)):
            start[at + 1] = False
            end = at + width
            end = end[end < n]
            follow = end[(kind[end] == _LETTER) & ~row_start[end]]
            start[follow] = True
    return np.flatnonzero(start)


class PieceTable:
    """What is known of distinct pieces, their token ids here, by 64-bit hash, filled as they are met."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in printable}
        letter |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letter[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.special, self.size = special, max([*ranks.values(), *special.values()]) + 1
        self._take(ranks)
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.clear()

    def _take(self, ranks: dict[bytes, int]) -> None:
        """Keep what the table needs of the vocabulary besides the encoder."""

    def values(self, pieces: list[bytes]) -> list[list[int]]:
        """What the table holds of each piece."""
        return [self.encode_piece(p) for p in pieces]

    def clear(self, most: int = 0) -> None:
        """Empty the table and give it room for ``most`` pieces, CACHE_PIECES at least."""
        self.mask = (1 << (2 * max(most, CACHE_PIECES) - 1).bit_length()) - 1
        self.key = np.zeros(self.mask + 1, np.uint64)
        self.at = np.zeros(self.mask + 1, np.int32)
        self.length = np.zeros(self.mask + 1, np.int32)
        self.pool = np.zeros(1 << 16, self.kind)
        self.filled = self.used = 0

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.core.encode_single_piece(piece)

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, found) of each hash; a slot that isn't found is free."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.key[slot]
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            key = self.key[slot[open_]]
            open_ = open_[(key != h[open_]) & (key != 0)]
        return slot, self.key[slot] == h

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of every piece, in a table that holds them all."""
        h = wb.hashes(data, starts, ends) | np.uint64(1)
        slot, found = self._probe(h)
        if not found.all():
            new, first = np.unique(h[~found], return_index=True)
            first = np.flatnonzero(~found)[first]
            if self.filled + len(new) > CACHE_PIECES:
                if self.filled:
                    self.clear()
                    return self.look_up(data, starts, ends)
                self.clear(len(new))
            raw = data.tobytes()
            sizes, flat = [], []
            for k in range(0, len(first), _ENCODED):
                part = first[k : k + _ENCODED]
                ids = self.values([raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat.append(np.fromiter(chain.from_iterable(ids), self.pool.dtype, int(sizes[-1].sum())))
            sizes, flat = np.concatenate(sizes), np.concatenate(flat)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.pool.dtype)])
            self.pool[self.used : self.used + len(flat)] = flat
            at = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.filled += len(new)
            pending = np.arange(len(new))
            where = (new & np.uint64(self.mask)).astype(np.int64)
            while len(pending):
                free = self.key[where[pending]] == 0
                _, lead = np.unique(where[pending], return_index=True)
                take = np.zeros(len(pending), bool)
                take[lead] = True
                take &= free
                own = pending[take]
                self.key[where[own]], self.at[where[own]], self.length[where[own]] = new[own], at[own], sizes[own]
                pending = pending[~take]
                where[pending] = (where[pending] + 1) & self.mask
            slot, _ = self._probe(h)
        return slot


class PrefixTable(PieceTable):
    """The token count of every byte prefix of distinct pieces, by dynamic programming on the prefix's last token.

    The encoding of a prefix is that of a shorter prefix and one more token; of the tokens that end it, just one forms a
    valid pair (a pair that encodes to itself) with the shorter prefix's own last token.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.kind = np.uint32
        self.clear()

    def _take(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = {i: w for w, i in ranks.items()}
        self.tails = {w[k:] for w in ranks for k in range(1, len(w))}
        self.valid: dict[tuple[int, int], bool] = {}

    def values(self, pieces: list[bytes]) -> list[list[int]]:
        """Token counts of the prefixes of 1, 2, ... bytes of each piece; in sorted order, a piece goes on from the prefix it shares with the one before."""
        out: list[list[int]] = [[]] * len(pieces)
        before, last, count = b"", [-1], [0]
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            piece = pieces[k]
            shared = min(len(before), len(piece))
            if before[:shared] != piece[:shared]:
                shared = next(i for i in range(shared) if before[i] != piece[i])
            del last[shared + 1 :], count[shared + 1 :]
            self._go_on(piece, last, count)
            out[k] = count[1:]
            before = piece
        return out

    def _go_on(self, piece: bytes, last: list[int], count: list[int]) -> None:
        """Lengthen the last tokens and the counts of the piece's prefixes, of 0, 1, ... bytes, to the whole piece."""
        ranks, tails, valid = self.ranks, self.tails, self.valid
        for j in range(len(count), len(piece) + 1):
            for i in range(j - 1, -1, -1):
                end = piece[i:j]
                token = ranks.get(end)
                if token is not None:
                    pair = (last[i], token)
                    if (ok := valid.get(pair)) is None:
                        word = self.words[pair[0]] if pair[0] >= 0 else b""
                        ok = self.core.encode_single_piece(word + end) == [t for t in pair if t >= 0]
                        if len(valid) > 1 << 18:
                            valid.clear()
                        valid[pair] = ok
                    if ok:
                        last.append(token)
                        count.append(count[i] + 1)
                        break
                if end not in tails:  # no longer token ends here
                    raise ValueError("a prefix has no encoding: the vocabulary lacks a byte")


@lru_cache(maxsize=2)
def table(path: str) -> PieceTable:
    return PieceTable(path)


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def prefix_counts(data: np.ndarray, offsets: np.ndarray, tokens: PrefixTable) -> np.ndarray:
    """Token count of the row's prefix that ends with each byte; right where a character ends.  Special strings are text.

    A prefix splits into the pieces of its row up to its last piece, and there the table has the count; but a prefix that
    ends in a run of white space has the run as one piece, and half a contraction is a mark and a letter.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    starts = piece_starts(data, offsets, kind)
    ends = np.append(starts[1:], n)
    first_of_row = np.zeros(n + 1, bool)
    first_of_row[offsets[:-1]] = True
    # a run of white space before other text: its last character begins a piece of its own or with that text
    white = kind[starts] == _SPACE
    at = np.flatnonzero(white[:-1] & white[1:] & ~first_of_row[starts[1:]])
    lead = data[starts[at + 1]]
    width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    run_end = starts[at + 1] + width
    every = tokens.look_up(data, np.concatenate([starts, starts[at]]), np.concatenate([ends, run_end]))
    slots, runs = every[: len(starts)], every[len(starts) :]
    size = ends - starts
    inner = tokens.pool[np.repeat(tokens.at[slots].astype(np.int64) - starts, size) + np.arange(n)].astype(np.int64)
    whole = inner[ends - 1]
    before = np.cumsum(whole) - whole
    row = np.searchsorted(starts, offsets[:-1])  # a row's first piece; of an empty row, the next one's
    row_base = np.append(before, whole.sum())[row]
    before -= np.repeat(row_base, np.diff(np.append(row, len(starts))))
    out = inner + np.repeat(before, size)
    out[run_end - 1] = before[at] + tokens.pool[tokens.at[runs] + (run_end - starts[at]) - 1]
    short = np.flatnonzero((size == 3) & (data[starts] == 0x27))
    short = short[kind[starts[short] + 1] == _LETTER]
    out[starts[short] + 1] = before[short] + 2
    return out


def special_prefix_counts(text: str, tokens: PrefixTable) -> np.ndarray:
    """`prefix_counts` of one text that may hold special strings, each one token where it is whole."""
    out, total, before = [], 0, b""

    def ordinary(raw: bytes) -> np.ndarray:
        return prefix_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tokens) + total

    for part, special in split_special(text, tokens):
        raw = part.encode()
        if special is None:
            before = raw
            continue
        cut = (before + raw)[:-1]  # a part of the special string is text, or holds a shorter one
        inner = cut.decode("utf-8", "ignore")
        held = any(s in inner for s in tokens.special)
        found = special_prefix_counts(inner, tokens) + total if held else ordinary(cut)
        out += [found, np.full(len(cut) - len(found), -1)]
        total = (int(found[len(before) - 1]) if before else total) + 1
        out.append(np.array([total]))
        before = b""
    if before:
        out.append(ordinary(before))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pieces(column: pa.Array, tokens: PieceTable):
    """Per chunk of rows: (first row, end row, piece lengths in bytes, pieces' row offsets, slots, special rows).

    A row that holds a special token's string has no pieces here; its index is in ``special rows``.
    """
    column = column.cast(pa.large_string()).fill_null("")
    odd = np.zeros(len(column), bool)
    for s in tokens.special:
        odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False).astype(bool)
    if odd.any():
        column = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), column)
    data, offsets = wb.text_bytes(column)
    for a, b in wb.chunks(offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts = piece_starts(d, o)
        ends = np.append(starts[1:], len(d)) if len(starts) else starts
        at = np.searchsorted(starts, o)
        slots = tokens.look_up(d, starts, ends) if len(starts) else np.zeros(0, np.int64)
        yield a, b, ends - starts, at, slots, np.flatnonzero(odd[a:b]) + a


def split_special(text: str, tokens: PieceTable) -> list[tuple[str, int | None]]:
    """The text in parts: (ordinary part, None) or (special string, its id), leftmost longest first."""
    import re

    if not tokens.special:
        return [(text, None)]
    pattern = re.compile("|".join(map(re.escape, sorted(tokens.special, key=len, reverse=True))))
    out, at = [], 0
    for m in pattern.finditer(text):
        if m.start() > at:
            out.append((text[at : m.start()], None))
        out.append((m[0], tokens.special[m[0]]))
        at = m.end()
    if at < len(text):
        out.append((text[at:], None))
    return out


def encode_text(text: str, tokens: PieceTable) -> tuple[list[int], list[int], list[int]]:
    """(ids, piece byte lengths, piece token counts) of one whole text, special strings included."""
    ids, lengths, counts = [], [], []
    for part, special in split_special(text, tokens):
        if special is not None:
            ids.append(special)
            lengths.append(len(part.encode()))
            counts.append(1)
            continue
        data = np.frombuffer(part.encode(), np.uint8)
        starts = piece_starts(data, np.array([0, len(data)]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True):
            own = tokens.encode_piece(bytes(data[a:b]))
            ids += own
            lengths.append(b - a)
            counts.append(len(own))
    return ids, lengths, counts
