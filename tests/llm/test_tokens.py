"""Token counts against the library, prefixes against re-encoding, training order against an exact round trip."""

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import bpe, common, tokencounts, trainorder

PATH = common.tokenizer_path()
#: The tokenizer's pattern of pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = ["", None, "hello  world\n\n x", "I'll don't 's 'tis '''re", "a<|endoftext|>b<|endoftext|>", "naïve 中文 😀  ½²", "word " * 5000, "x" * 3000, "\n \t  end ", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def counted(texts):
    t = bpe.table(PATH)
    out = np.zeros(len(texts), int)
    column = pa.array(texts, pa.string())
    for a, b, _, at, slots, odd in bpe.pieces(column, t):
        upto = np.concatenate([[0], np.cumsum(t.length[slots])])
        out[a:b] = upto[at[1:]] - upto[at[:-1]]
        for i in odd:
            out[i] = len(bpe.encode_text(texts[i], t)[0])
    return out.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\n\tsdtmrevl<|endoftext|>")), max_size=40), max_size=5))
def test_counts_are_the_librarys(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    assert counted(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def library_prefixes(lib, text):
    return [len(e.ids) for e in lib.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from("abre 'stlmv\n é中\u00a0\u3000\t <|>19!"), st.sampled_from(["<|endoftext|>", "'ll", "  ", "hello"])), max_size=25).map("".join), max_size=4))
def test_every_prefix(texts):
    from tokenizers import Tokenizer

    lib, t = Tokenizer.from_file(PATH), bpe.prefix_table(PATH)
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    together = bpe.prefix_counts(np.frombuffer(b"".join(raw), np.uint8), offsets, t)
    for k, text in enumerate(texts):
        odd = "<|endoftext|>" in text
        counts = bpe.special_prefix_counts(text, t) if odd else together[offsets[k] : offsets[k + 1]]
        ends = np.cumsum([len(c.encode()) for c in text]).astype(int) - 1
        assert counts[ends].tolist() == library_prefixes(lib, text)


def test_stored_tables():
    for counts in ([], [1], [1, 2, 1, 1, 3], [1, 500, 20, 90_000]):
        table = tokencounts.pack(np.array(counts, int))
        assert tokencounts.unpack(table).tolist() == counts and tokencounts.count_at(table, 0) == 0
        assert [tokencounts.count_at(table, k + 1) for k in range(len(counts))] == counts
    assert tokencounts.longest_prefix(tokencounts.pack(np.array([1, 2, 3, 2, 4])), 2) == 4 and tokencounts.longest_prefix(b"\x01", 5) == 0


def test_every_prefix_of_the_smallest_tables(spark, library):
    """Short documents at every prefix, long ones at about 60 of them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tokencounts.token_prefixes(docs).collect():
        text, counts = texts[r.doc_id], tokencounts.unpack(r.prefix_tokens).tolist()
        assert len(counts) == len(text)
        at = range(1, len(text) + 1) if len(text) < 400 else sorted({1, len(text), *range(7, len(text), max(1, len(text) // 60))})
        got = [len(e.ids) for e in library.encode_batch([text[:k] for k in at], add_special_tokens=False)]
        assert [counts[k - 1] for k in at] == got, r.doc_id
        for budget, cut in zip(tokencounts.BUDGETS, r.cut_bytes, strict=True):
            chars = tokencounts.longest_prefix(r.prefix_tokens, budget)
            assert cut == len(text[:chars].encode()) and (counts[chars - 1] if chars else 0) <= budget and all(c > budget for c in counts[chars:])


def test_query_rows(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in tokencounts.token_prefixes(docs, limit=64, budgets=(64, 3)).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 64)
        assert tokencounts.unpack(got[i].prefix_tokens)[-1:].tolist() == ([len(ids)] if t else [])
        for budget, cut in zip((64, 3), got[i].cut_bytes, strict=True):
            assert len(library.encode((t or "").encode()[:cut].decode(), add_special_tokens=False).ids) <= budget
    assert tokencounts.token_prefixes(docs.limit(0)).count() == 0
    assert "prefix_tokens" not in tokencounts.token_prefixes(docs, budgets=(), steps=False).columns


def test_a_long_text_of_many_distinct_pieces(spark, library):
    text = " ".join(f"w{k:x}q{k * 7919 % 99991}" for k in range(420_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = tokencounts.token_prefixes(docs).collect()
    assert len(text) > 5_000_000 and r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(trainorder.feistel(np.arange(n), n, 5).tolist()) == list(range(n))
    assert trainorder.feistel(np.arange(100), 100, 1).tolist() != trainorder.feistel(np.arange(100), 100, 2).tolist()


def test_shards_round_trip(spark, library, tmp_path):
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3, "doc_id")
    docs = common.written(docs, "in")
    s = trainorder.write_shards(docs, str(tmp_path / "shards"), length=16, shard_records=128)
    rows = trainorder.read_records(spark, s, 0, s.sequences)
    assert [r[0] for r in rows] == list(range(s.sequences)) and s.shards == -(-s.sequences // 128)
    assert trainorder.read_records(spark, s, 120, 20) == rows[120:140]
    back: dict = {}
    for _, doc, seq, ids in rows:
        back.setdefault(doc, []).append((seq, ids))
    for i, text in enumerate(TEXTS):
        key = -(1 << 63) if i == 3 else i
        # special strings are ordinary text to this operator, so the library gets the pieces of those texts
        parts = regex.findall(PIECES, text) if "<|" in (text or "") else [text or ""]
        want = [x for part in parts for x in library.encode(part, add_special_tokens=False).ids]
        assert [x for _, ids in sorted(back[key]) for x in ids] == want
    table = trainorder.shard_rows(spark, s).collect()
    assert sorted(r.slot for r in table) == list(range(s.sequences)) and any(r.doc_id is None for r in table)


def test_same_key_same_order_and_empty_input(spark, tmp_path):
    docs = common.written(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"), "in")
    a, b = (trainorder.shard_rows(spark, trainorder.write_shards(docs, str(tmp_path / k), length=8)).orderBy("slot").collect() for k in "ab")
    assert a == b
    empty = trainorder.write_shards(docs.limit(0), str(tmp_path / "c"))
    assert empty.sequences == 0 and trainorder.shard_rows(spark, empty).count() == 0


def test_code_of_any_ids():
    rng = np.random.default_rng(4)
    for size, kind in ((50_257, np.uint16), (300, np.uint16), (100_000, np.uint32)):
        ids = np.concatenate([np.arange(size), rng.zipf(1.3, 5_000) % size]).astype(kind)
        starts = np.concatenate([[0, 0], np.sort(rng.integers(0, len(ids), 50)), [len(ids)]])
        for often in (np.bincount(ids[size:], minlength=size), np.zeros(size, np.int64)):
            code = trainorder.Code.of(often)
            columns = [trainorder._binary(*c) for c in code.encoder()(ids, starts)]
            for a, b in ((0, len(starts) - 1), (0, 1), (7, 20)):  # rows of a column that is a slice, too
                lead, second, whole = (trainorder._bytes(c.slice(a, b - a), k)[0] for c, k in zip(columns, ("u1", "u1", np.dtype(kind).str), strict=True))
                assert code.decoder(np.dtype(kind))(lead, second, whole).tolist() == ids[starts[a] : starts[b]].tolist()


def test_the_shuffle_is_smaller_than_the_shards(spark, tmp_path):
    store, lists = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList

    def shuffled():
        stages = store.stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), lists())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    docs = common.written(common.read(spark, "/root/testdata/sf0.01", "documents"), "in")
    before = shuffled()
    s = trainorder.write_shards(docs, str(tmp_path / "shards"))
    assert 0 < shuffled() - before < 0.62 * s.sequences * s.stride


def test_a_text_of_more_distinct_pieces_than_the_cache_holds(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 64)
    monkeypatch.setattr(bpe, "_ENCODED", 100)
    t = bpe.PieceTable(PATH)
    for text in ("a few words", " ".join(f"w{k}x {k * 7919}" for k in range(3000)), "a few words again", " ".join(f"v{k}" for k in range(500))):
        ((_, _, lengths, _, slots, _),) = bpe.pieces(pa.array([text]), t)
        ids = np.concatenate([t.pool[a : a + n] for a, n in zip(t.at[slots].tolist(), t.length[slots].tolist(), strict=True)])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and lengths.sum() == len(text)
