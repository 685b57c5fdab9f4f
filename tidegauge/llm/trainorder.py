"""Operator 1, token-ID / binary output: training-order materialisation into fixed-stride shards.

Every document is encoded and cut into sequences of ``length`` tokens (the last one padded); the sequences are numbered
densely by (input partition, position), and a keyed Feistel permutation with cycle-walking maps each number to its global
slot.  Slots are range-partitioned: shard k holds slots [k*S, (k+1)*S) in order, one file of fixed-stride records, so that
record s lies at byte (s mod S) * stride of shard s div S.  Two passes over the input: counts first, then the shuffle.
The shuffle carries no padding and frequent ids as one byte (``Code``); records are made of it where shards are written.

Record: doc_id int64, sequence number int32, token count int32, ``length`` token ids (uint16, or uint32 for a vocabulary
over 65,536), line feed; little-endian.  Padding repeats the end-of-text id.

Defined cases: a null or empty text gives one sequence of no tokens, so every row is in the output; a null doc_id is
written as -2**63; repeated rows are written each; special strings inside texts are ordinary text; an empty table gives a
folder with no shard.  The second pass checks that each input partition holds what the first one counted, and fails else.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, wordbytes
from .common import bounded_batches, new_path, read, released, tokenizer_path

_NO_ID = -(1 << 63)
_ROUNDS = 4


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of [0, size): a balanced Feistel network on the next even power of two, walked until inside."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = wordbytes.mix64(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (wordbytes.mix64(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    walking = np.flatnonzero(out >= size)
    while len(walking):
        out[walking] = once(out[walking])
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Shards:
    """Where the shards lie and how they are laid out; written beside them as manifest.json."""

    path: str
    sequences: int
    length: int
    width: int
    shard_records: int
    key: int

    @property
    def stride(self) -> int:
        return 16 + self.length * self.width + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.shard_records)


def _sequences(column: pa.Array, tokens: bpe.PieceTable, length: int):
    """Per chunk: (first row, token ids, tokens per row); rows with a special string are encoded as ordinary text."""
    for a, _, _, rows, slots, odd in bpe.pieces(column, tokens):
        sizes = tokens.length[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = tokens.pool[np.repeat(tokens.at[slots].astype(np.int64) - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[rows]
        if len(odd):  # rare: put in where they belong
            parts, counts = [], np.diff(upto)
            own = set(odd.tolist())
            for i in range(len(upto) - 1):
                if a + i in own:
                    raw = np.frombuffer(column[a + i].as_buffer().to_pybytes(), np.uint8)
                    at = bpe.piece_starts(raw, np.array([0, len(raw)])).tolist()
                    x = np.array([t for s, e in zip(at, [*at[1:], len(raw)], strict=True) for t in tokens.encode_piece(bytes(raw[s:e]))], ids.dtype)
                    counts[i] = len(x)
                    parts.append(x)
                else:
                    parts.append(ids[upto[i] : upto[i + 1]])
            ids, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        yield a, ids, np.diff(upto)


#: One-byte codes; those that begin a code of two bytes; then there is one for ids that are written out.
_SINGLE, _DOUBLE = 224, 31
_ESCAPE = _SINGLE + _DOUBLE


@dataclass(frozen=True)
class Code:
    """Ids as bytes: a leading one for each, a second one for the less frequent, whole ids for the rest; any id has a code.

    ``order`` is ids by falling frequency; it decides how long codes are, and nothing else.
    """

    order: np.ndarray
    size: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        return cls(np.argsort(-counts, kind="stable")[: _SINGLE + (_DOUBLE << 8)].astype(np.uint32), len(counts))

    def encoder(self):
        rank = np.arange(len(self.order)) - _SINGLE
        first, second = np.full(self.size, _ESCAPE, np.uint8), np.zeros(self.size, np.uint8)
        first[self.order] = np.where(rank < 0, rank + _SINGLE, _SINGLE + (rank >> 8))
        second[self.order] = rank & 255

        def encode(ids: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            """(values, offsets) of leading bytes, second bytes, whole ids of the sequences between ``starts``."""
            lead = first[ids]
            out = [(lead, starts)]
            for which, values in (((lead >= _SINGLE) & (lead < _ESCAPE), second), (lead == _ESCAPE, None)):
                at = np.flatnonzero(which)
                out.append((ids[at] if values is None else values[ids[at]], np.searchsorted(at, starts)))
            return out

        return encode

    def decoder(self, kind: np.dtype):
        known = np.zeros(_SINGLE + (_DOUBLE << 8), kind)
        known[: len(self.order)] = self.order

        def decode(lead: np.ndarray, second: np.ndarray, whole: np.ndarray) -> np.ndarray:
            ids = known[lead]
            at = np.flatnonzero((lead >= _SINGLE) & (lead < _ESCAPE))
            ids[at] = known[_SINGLE + ((lead[at].astype(np.int64) - _SINGLE) << 8) + second]
            ids[lead == _ESCAPE] = whole
            return ids

        return decode


def _surveyed(part: int) -> bool:
    """Whether an input partition reports how frequent its ids are: the first 32 and 16 of each power of two after."""
    low = max(0, part.bit_length() - 5)
    return part >> low << low == part


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, bytes of each) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw.copy().view(kind), np.diff(ends)


def _counted(batches: Iterator[pa.RecordBatch], path: str | None, length: int):
    """(doc ids, ids, tokens per row, sequences per row) of each chunk; without ``path``, by the tokenizer file of this machine."""
    tokens = bpe.table(path or tokenizer_path())
    for batch in batches:
        column = batch.column("text").cast(pa.large_string()).fill_null("")
        keys = batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for a, ids, counts in _sequences(column, tokens, length):
            yield keys[a : a + len(counts)], ids, counts, np.maximum(1, -(-counts // length))


def write_shards(docs: DataFrame, folder: str, *, path: str | None = None, length: int = 256, key: int = 20240229, shard_records: int | None = None) -> Shards:
    """Write ``docs`` (doc_id, text) in training order under ``folder`` and return the layout.

    ``shard_records`` defaults to 8,192, more where that would make over 65,536 shards.
    """
    spark = docs.sparkSession
    here = bpe.table(path or tokenizer_path())
    eot, width = next(iter(here.special.values()), 0), here.pool.dtype.itemsize
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    size = here.size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, digest, part = 0, 0, TaskContext.get().partitionId()
        often = np.zeros(size, np.int64)
        for keys, ids, counts, made in _counted(batches, path, length):
            total += int(made.sum())
            digest = zlib.crc32(counts.astype("<i8").tobytes(), zlib.crc32(keys.astype("<i8").tobytes(), digest))
            if _surveyed(part):
                often += np.bincount(ids, minlength=size)
        top = Code.of(often).order
        top = top[often[top] > 0]
        yield pa.RecordBatch.from_pydict({"part": [part], "made": [total], "digest": [digest], "ids": [top.astype("<u4").tobytes()], "often": [often[top].astype("<i8").tobytes()]})

    # one row per input partition
    rows = source.transform(bounded_batches).mapInArrow(released(measure), "part long, made long, digest long, ids binary, often binary").collect()
    found = {r.part: (r.made, r.digest) for r in rows}
    often = np.zeros(size, np.int64)
    for r in rows:
        often[np.frombuffer(r.ids, "<u4")] += np.frombuffer(r.often, "<i8")
    code = Code.of(often)
    base, at_index = {}, 0
    for part in sorted(found):
        base[part] = at_index
        at_index += found[part][0]
    total = at_index
    per = shard_records or max(1 << 13, 1 << max(0, (-(-total // 65_536) - 1)).bit_length())
    layout = Shards(folder, total, length, width, per, key)
    known = spark.sparkContext.broadcast((base, found, code))
    kind = np.dtype([("doc", "<i8"), ("seq", "<i4"), ("n", "<i4"), ("ids", f"<u{width}", (length,))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        bases, were, code = known.value
        encode = code.encoder()
        index, digest = bases.get(part, 0), 0
        for keys, ids, counts, made in _counted(batches, path, length):
            digest = zlib.crc32(counts.astype("<i8").tobytes(), zlib.crc32(keys.astype("<i8").tobytes(), digest))
            n = int(made.sum())
            seq = np.arange(n) - np.repeat(np.cumsum(made) - made, made)
            held = np.minimum(length, np.repeat(counts, made) - seq * length)
            coded = encode(ids, np.concatenate([[0], np.cumsum(held)]))
            slot = feistel(np.arange(index, index + n), total, key)
            index += n
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.repeat(keys, made)), pa.array(seq.astype(np.int32)), *(_binary(*c) for c in coded)], ["slot", "doc", "seq", "lead", "second", "whole"])
        if (index - bases.get(part, 0), digest) != were.get(part, (0, 0)):
            raise RuntimeError(f"input partition {part} differs between the passes; write the input to a table first")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = known.value[2].decoder(np.dtype(f"<u{width}"))
        for batch in batches:
            n = len(batch)
            lead, counts = _bytes(batch.column("lead"), "u1")
            record = np.empty(n, kind)
            record["doc"], record["seq"], record["n"] = batch.column("doc"), batch.column("seq"), counts
            body = np.full(n * length, eot, f"<u{width}")
            pad = np.arange(n) * length - (np.cumsum(counts) - counts)
            body[np.arange(len(lead)) + np.repeat(pad, counts)] = decode(lead, _bytes(batch.column("second"), "u1")[0], _bytes(batch.column("whole"), f"<u{width}")[0])
            record["ids"] = body.reshape(n, length)
            slot = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(slot // per), pa.array(slot), _binary(record.view(np.uint8), np.arange(n + 1) * kind.itemsize)], ["shard", "slot", "record"])

    placed = source.transform(bounded_batches).mapInArrow(released(place), "slot long, doc long, seq int, lead binary, second binary, whole binary")
    parts = max(1, min(layout.shards, 1 << 16))
    ranged = placed.repartitionById(parts, (F.expr(f"slot div {per}") * parts / max(1, layout.shards)).cast("int"))
    # records before the sort, so that their order is the files'
    ranged = ranged.mapInArrow(released(records), "shard long, slot long, record binary")
    (
        ranged.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
        .write.mode("overwrite").option("lineSep", "\n").option("compression", "none").partitionBy("shard").text(folder)
    )
    known.unpersist()
    _put(spark, f"{folder}/_manifest.json", json.dumps(asdict(layout)).encode())
    return layout


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def read_records(spark: SparkSession, shards: Shards, first: int, count: int) -> list[tuple[int, int, int, list[int]]]:
    """(slot, doc_id, sequence number, ids) of ``count`` slots from ``first`` on: seeks, then reads on; for resuming a run."""
    jvm = spark.sparkContext._jvm
    out: list[tuple[int, int, int, list[int]]] = []
    while count > 0 and first < shards.sequences:
        shard, inside = divmod(first, shards.shard_records)
        take = min(count, shards.shard_records - inside, shards.sequences - first)
        folder = jvm.org.apache.hadoop.fs.Path(f"{shards.path}/shard={shard}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        (file,) = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        stream = fs.open(file)
        stream.seek(inside * shards.stride)
        raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, take * shards.stride))
        stream.close()
        for k, r in enumerate(_parsed(raw, shards)):
            out.append((first + k, int(r["doc"]), int(r["seq"]), r["ids"][: r["n"]].tolist()))
        first, count = first + take, count - take
    return out


def _parsed(raw: bytes, shards: Shards) -> np.ndarray:
    kind = np.dtype([("doc", "<i8"), ("seq", "<i4"), ("n", "<i4"), ("ids", f"<u{shards.width}", (shards.length,)), ("end", "u1")])
    return np.frombuffer(raw, kind)


def shard_rows(spark: SparkSession, shards: Shards) -> DataFrame:
    """What the shards hold, read back: a row per record with its place and a checksum of its ids."""
    schema = "slot long, doc_id long, seq_no int, n_tokens int, shard int, byte_offset long, ids_crc32 long"
    if not shards.sequences:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(shards.path)
    per, stride = shards.shard_records, shards.stride

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                r = _parsed(content.as_buffer().to_pybytes(), shards)
                k = np.arange(len(r))
                crc = np.fromiter((zlib.crc32(x["ids"][: x["n"]].tobytes()) for x in r), np.int64, len(r))
                doc = pa.array(r["doc"], mask=r["doc"] == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(shard * per + k), doc, pa.array(r["seq"]), pa.array(r["n"]), pa.array(np.full(len(r), shard, np.int32)), pa.array(k * stride), pa.array(crc)], ["slot", "doc_id", "seq_no", "n_tokens", "shard", "byte_offset", "ids_crc32"])

    return files.select(F.col("shard").cast("int").alias("shard"), "content").transform(bounded_batches).mapInArrow(released(parse), schema)


def training_order(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the shards to a fresh place in the shared folder and return their rows."""
    return shard_rows(spark, write_shards(docs, new_path(spark, "shards", keep=True), **options))


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(spark, read(spark, sf_dir, "documents"))
