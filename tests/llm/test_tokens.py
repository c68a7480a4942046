"""Token files and the chunk codec against the tokenizers library."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest_llm import PROSE, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from catalume.llm import chunkcodec, queries, rangecoder, tokenfiles
from catalume.llm.tokens import ByteEncoder, WordEncoder, encoder, library

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["<|endoftext|> a <|startoftext|>", "don't can't I'll  two  spaces ", "a b 　 c", "Ünï ́ combining", "tab\tnew\nline \r\n x", "1234567 890", "§ ¶ ± ~ ^ § §§", " lead", "trail ", "ＡＢＣ ﬁ İ ß ſ"]


ENCODERS = {BYTES: encoder(BYTES, "<u4"), WORDS: WordEncoder(WORDS, "<u4"), "library": encoder(WORDS, "<u4")}
PLAIN = {BYTES: library(BYTES), WORDS: library(WORDS), "library": library(WORDS)}


def by_library(plain, text):
    return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ENCODERS)
def test_encoders_give_the_ids_of_the_library(name, odd_rows):
    texts = [*HARD, *(t or "" for _, t in odd_rows), "y" * 300_000, " \n" * 200_000 + "end"]
    assert ENCODERS[name].encode(texts) == [by_library(PLAIN[name], t) for t in texts]
    assert isinstance(ENCODERS[BYTES], ByteEncoder)


def test_ranks_give_the_ids_of_the_library_for_every_character():
    texts = [f"a{c}b 1{c}2 {c} .{c}. {c}{c}x\n{c} " for c in map(chr, range(0x30000)) if not "\ud800" <= c < "\ue000"]
    got = ENCODERS[BYTES].encode(texts)
    want = PLAIN[BYTES].encode_batch_fast(texts, add_special_tokens=False)
    assert all(a == np.array(e.ids, "<u4").tobytes() for a, e in zip(got, want, strict=True))


def test_whole_table_against_the_library():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for name in (BYTES, WORDS):
        assert ENCODERS[name].encode(texts) == [by_library(PLAIN[name], t) for t in texts]
    held = chunkcodec.ChunkEncoder(WORDS)
    assert held.encode(texts) == ENCODERS[WORDS].encode(texts)


ANY = st.lists(st.text(st.sampled_from(" \n\t ab'É1§<|>.漢\U0001f600́s"), max_size=30), max_size=5)


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_encoders_give_the_ids_of_the_library_for_any_text(texts):
    for name, held in ENCODERS.items():
        assert held.encode(texts) == [by_library(PLAIN[name], t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(ANY, st.integers(0, 2))
def test_chunks_give_the_ids_of_the_library_for_any_text(texts, bits):
    """Many cuts: a short window, and chunks of a few bytes."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chunkcodec, "_MASK", np.uint32(((1 << bits) - 1) << (32 - bits)))
        m.setattr(chunkcodec, "LEAST", 1)
        held = chunkcodec.ChunkEncoder.__new__(chunkcodec.ChunkEncoder)
        held.words, held.known, held.joins, held.encoded, held.repaired = ENCODERS[WORDS], chunkcodec.Store(50), chunkcodec.Store(6), 0, 0
        for t in (texts, [" ".join(texts) * 3, *texts]):
            assert held.encode(t) == [by_library(PLAIN[WORDS], x) for x in t]


def test_joins_are_repaired_by_wider_windows(monkeypatch):
    """Where no narrow window agrees, wider ones are asked, and the whole text last."""
    text = " ".join(f"word{i * i % 7919}" for i in range(900))
    for fails in (0, 1, 3, 10**9):
        asked, plain = [], chunkcodec._between
        monkeypatch.setattr(chunkcodec, "_between", lambda ids, a, b: asked.append(1) or (None if len(asked) <= fails else plain(ids, a, b)))
        held = chunkcodec.ChunkEncoder(WORDS)
        assert held.encode([text]) == [by_library(PLAIN[WORDS], text)]
        assert len(asked) > held.repaired > 3 or not fails
        monkeypatch.undo()


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [65535] * 3000, rng.integers(0, 65536, 5000), np.minimum(rng.zipf(1.3, 9001), 65535), list(range(2049)), rng.integers(0, 4, 1024)):
        ids = np.asarray(ids, np.int64)
        data = rangecoder.pack_segment(ids)
        assert (rangecoder.unpack_segment(data) == ids).all()
    assert len(rangecoder.pack_segment(np.full(100_000, 17))) < 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.integers(1, 40))
def test_range_coder_round_trip_of_anything(ids, block):
    ids = np.array(ids, np.int64)
    shares = rangecoder.shares_of(ids)
    payloads = rangecoder.encode_blocks(ids, block, shares)
    assert shares.sum() in (0, 65536) and rangecoder.decode_blocks(payloads, len(ids), block, shares).tolist() == ids.tolist()
    for k in range(len(payloads)):  # each block by itself
        own = ids[k * block : (k + 1) * block]
        assert rangecoder.decode_blocks(payloads[k : k + 1], len(own), block, shares).tolist()[: len(own)] == own.tolist() or len(own) < min(block, len(ids))


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(1).integers(0, 5000, 4000)
    data = bytearray(rangecoder.pack_segment(ids))
    data[-7] ^= 1
    with pytest.raises(ValueError, match="block"):
        rangecoder.unpack_segment(bytes(data))
    data[-7] ^= 1
    data[25] ^= 1
    with pytest.raises(ValueError, match="shares"):
        rangecoder.unpack_segment(bytes(data))
    data[25] ^= 1
    assert (rangecoder.unpack_segment(bytes(data)) == ids).all()
    with pytest.raises(ValueError):
        rangecoder.unpack_segment(b"XXXX" + bytes(data[4:]))


def test_blocks_are_smaller_than_deflated_ones():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    ids = np.frombuffer(b"".join(ENCODERS[BYTES].encode(texts)), "<u4").astype("<u2")
    deflated = sum(len(zlib.compress(ids[i : i + rangecoder.BLOCK].tobytes(), 9)) for i in range(0, len(ids), rangecoder.BLOCK))
    data = rangecoder.pack_segment(ids)
    assert (rangecoder.unpack_segment(data) == ids).all() and len(data) < 0.85 * deflated


def test_coding_and_reading_cost_less_than_the_encoding():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:3000]]
    ENCODERS[BYTES].encode(texts[:10])
    began = time.process_time()
    ids = np.frombuffer(b"".join(ENCODERS[BYTES].encode(texts)), "<u4").astype("<u2")
    encoded = time.process_time() - began
    data = rangecoder.pack_segment(ids)  # what is done once a process
    began = time.process_time()
    data = rangecoder.pack_segment(ids)
    got = rangecoder.unpack_segment(data)
    assert time.process_time() - began < encoded and (got == ids).all()


def test_counted_chances_are_kept_in_the_head():
    ids = np.tile(np.arange(700), 300)
    shares, chances = rangecoder.shares_of(ids), rangecoder.chances_of()
    counted = rangecoder.pack_segment(ids)
    plain = sum(map(len, rangecoder.encode_blocks(ids, shares=shares)))
    assert chances.sum(1).max() < 65536 and (rangecoder.unpack_segment(counted) == ids).all() and len(counted) < plain


def test_token_files_round_trip(spark, odd_rows, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(documents(spark, odd_rows), path, BYTES, segment=2000)
    got = tokenfiles.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    plain = library(BYTES)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i))
    want = sorted((str(i), np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in odd_rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want


def test_chunk_codec_by_the_library(spark, odd_rows, tmp_path):
    rows = [*odd_rows, *((100 + k, f"{t} {PROSE * 9}{t}") for k, t in enumerate(HARD)), *((200 + k, t) for k, t in enumerate(HARD))]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_chunk_codec(spark, str(tmp_path)).collect()
    plain = library(WORDS)
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_shared_chunks_are_encoded_once():
    held = chunkcodec.ChunkEncoder(WORDS)
    passage = " ".join(f"word{i * i % 7919}" for i in range(3000))
    held.encode(["first words before it " + passage])
    once, joins = held.encoded, held.repaired
    held.encode([f"number {k} goes before " + passage + f" and {k} after" for k in range(5)])
    assert once > 10 and held.encoded - once < 0.25 * 5 * once
    assert held.repaired - joins < 0.35 * 5 * joins


def test_empty_tables(spark, tmp_path):
    empty = documents(spark, [])
    assert chunkcodec.encode_documents(empty, WORDS).count() == 0
    tokenfiles.write_tokens(empty, str(tmp_path / "none"), BYTES)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).count() == 0
