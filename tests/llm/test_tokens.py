"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, SMOKE, documents
from tidepool.llm import byte_bpe as B
from tidepool.llm import common, packing
from tidepool.llm.token_count import PATTERN, MergeTable, byte_symbols, token_counts

COUNTED = P.path("byte_bpe_50k.json")
PACKED = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(open(RANKS, "rb").read())


def smoke_texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(9, 14), 0x85, 0xA0,
                                   rng.randrange(0xC0, 0x250), rng.randrange(0x300, 0x370),
                                   rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F300, 0x1F400)]))
    return ["".join(pick() for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def test_pattern_is_the_vocabulary_s():
    assert PATTERN == P.PATTERN
    assert len(set(byte_symbols())) == 256


def test_counts_match_the_library(spark):
    texts = [*ODD_TEXTS, *random_texts(60), *smoke_texts(spark)]
    tok = Tokenizer.from_file(COUNTED)
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r for r in token_counts(documents(spark, texts, extra=["n_tokens"]),
                                             COUNTED).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())


def test_long_texts_pass_in_chunks(spark, monkeypatch):
    texts = [*ODD_TEXTS, *random_texts(10)]
    docs = documents(spark, texts)
    monkeypatch.setattr(common, "LONG_CHARS", 10)
    monkeypatch.setattr(common, "BATCH_PIECES", 3)
    tok = Tokenizer.from_file(COUNTED)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, COUNTED).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids)
                   for i, t in enumerate(texts)}
    bpe = {r.doc_id: r for r in B.byte_bpe(docs, RANKS, P.PATTERN).collect()}
    assert all(bpe[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
               for i, t in enumerate(texts))


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert token_counts(docs, COUNTED).collect() == []
    assert B.byte_bpe(docs, RANKS, P.PATTERN).collect() == []
    assert packing.pack_documents(docs, PACKED).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        MergeTable(open(PACKED, "rb").read())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abAB '1!é", min_size=1, max_size=30), min_size=1, max_size=5))
def test_merges_match_by_word(words):
    table = common.per_process("test-table", lambda: MergeTable(open(COUNTED, "rb").read()))
    tok = common.per_process("test-library", lambda: Tokenizer.from_file(COUNTED))
    want = [len(tok.model.tokenize("".join(byte_symbols()[b] for b in w.encode())))
            for w in words]
    assert table.count([w.encode() for w in words]).tolist() == want


def test_byte_bpe_matches_the_library(spark, reference):
    texts = [*ODD_TEXTS, *random_texts(60), *smoke_texts(spark)]
    got = {r.doc_id: r for r in B.byte_bpe(documents(spark, texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_round_trip(spark, reference):
    texts = [*ODD_TEXTS, *random_texts(20)]
    docs = documents(spark, texts)
    rows = docs.select("text", B.encode_ids(docs, RANKS, P.PATTERN).alias("ids"))
    rows = rows.select("text", "ids", B.decode_ids(rows, RANKS).alias("back")).collect()
    assert all(r.ids == reference.encode_ordinary(r.text or "") for r in rows)
    assert all(bytes(r.back) == (r.text or "").encode() for r in rows)
    nothing = spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert nothing.select(B.decode_ids(nothing, RANKS).alias("b")).first().b is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehilnorst ABé1!", min_size=1, max_size=60))
def test_backtracking_equals_merging(piece):
    vocab = common.per_process("test-ranks", lambda: B.Vocabulary(open(RANKS, "rb").read()))
    latin = piece.encode().decode("latin-1")
    assert vocab.backtracked(latin) == [vocab.rank[t] for t in vocab.merged(latin)]


def packed_ids(texts):
    tok = Tokenizer.from_file(PACKED)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_packing(rows, ids, capacity=2048):
    """Every id once, pieces as cut, sequences gapless and within bounds."""
    of_doc, of_sequence = {}, {}
    for r in rows:
        of_doc.setdefault(r.doc_id, []).append(r)
        of_sequence.setdefault(r.sequence_id, []).append(r)
    for i, own in enumerate(ids):
        at = 0
        for r in sorted(of_doc.get(i, []), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            piece = np.array(own[at:at + r.length], dtype="<u4")
            assert zlib.crc32(piece.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(own)
    for own in of_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return of_sequence


def test_packing_matches_the_library(spark):
    texts = [*ODD_TEXTS, *random_texts(40), *smoke_texts(spark)]
    rows = packing.pack_documents(documents(spark, texts, extra=["offset"]), PACKED).collect()
    sequences = check_packing(rows, packed_ids(texts))
    total = sum(r.length for r in rows)
    assert len(sequences) * 2048 <= 1.02 * total + 4096


def test_packing_in_many_groups_and_long_texts(spark, monkeypatch):
    texts = ["x y " * 30_000, *[f"text number {i} of many" for i in range(50)]]
    cut = packing.pack_documents(documents(spark, texts), PACKED, capacity=64).collect()
    check_packing(cut, packed_ids(texts), 64)
    pieces = documents(spark, texts).select("doc_id", F.lit(7).cast("bigint").alias("length"))
    rows = packing.pack(pieces, capacity=64, group_pieces=4).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 3
    monkeypatch.setattr(common, "LONG_CHARS", 10)
    monkeypatch.setattr(common, "BATCH_PIECES", 3)
    check_packing(packing.pack_documents(documents(spark, ODD_TEXTS), PACKED).collect(),
                  packed_ids(ODD_TEXTS))


def test_packing_with_little_memory_is_the_same(spark):
    texts = [*ODD_TEXTS, *random_texts(40), *smoke_texts(spark)]
    docs = documents(spark, texts)
    rows = packing.pack_documents(docs, PACKED, known_words=50, slice_bytes=2_000).collect()
    check_packing(rows, packed_ids(texts))
    pieces = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows}
    assert pieces == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in
                      packing.pack_documents(docs, PACKED).collect()}


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rows = packing.pack_documents(documents(spark, ["a b", "a b", "c", None],
                                            ids=[None, None, 5, 5]), PACKED).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (False, 2),
                                                                  (True, 3), (True, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 20)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(20)
        want[i] = (k, 20 - room[k])
        room[k] -= lengths[i]
    assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [
        want[i] for i in range(len(lengths))]


def test_too_long_pieces_fail(spark):
    with pytest.raises(Exception, match="length out of range"):
        packing.pack(spark.range(1).select(F.lit(9).alias("length")), capacity=8).collect()
