"""Byte-level BPE and token files against the public libraries, and their edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import byte_bpe, token_store
from plumbline.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "Plain words, here. And  more\n\n lines!"), (2, None), (3, ""), (4, " \t\n "), (5, "é ü ß 日本語 ́e İstanbul ΣΑΣ"),
    (6, "a" * 5000), (7, "ab" * 3000 + "1234567890" * 100), (8, "don't we'll it's 3.14 ... ,,, x.,"), (9, "\x1c\x85 |​|﻿"),
    (9, "twice"), (None, "no id"), (10, "<|endoftext|> <|startoftext|>"), (11, "emoji 👩‍👩‍👧 🇫🇷 ＦＵＬＬ Å K µ ª ŉ"),
]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.ranks_of(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_as_the_library_and_decode(frame, library):
    docs = frame(ODD)
    rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.score == 2 and r.kept == "x"


def test_decode_alone_and_clashes(frame, spark):
    docs = byte_bpe.encode(frame(ODD), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in byte_bpe.decode(docs, RANKS).collect())
    assert byte_bpe.encode(frame([]), RANKS, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


@given(st.binary(min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_merge_takes_the_leftmost_least_pair(piece):
    ranks = test_merge_takes_the_leftmost_least_pair.ranks
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            break
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert list(byte_bpe.merge(piece, ranks, max(map(len, ranks)))) == [ranks[p] for p in parts]


test_merge_takes_the_leftmost_least_pair.ranks = byte_bpe.ranks_of(RANKS)


@given(st.integers(-2, 2), st.sampled_from([1, 2, byte_bpe.FAN, byte_bpe.FAN + 5, byte_bpe.FAN**2]), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_merge_where_the_nodes_of_the_tree_end(library, more, fans, rng):
    ranks = test_merge_takes_the_leftmost_least_pair.ranks
    piece = "".join(rng.choice("aab e日") for _ in range(max(1, byte_bpe.FAN * fans + more) if fans < 3 else fans + more))
    assert list(byte_bpe.merge(piece.encode(), ranks, max(map(len, ranks)))) == library._core_bpe.encode_single_piece(piece.encode())


@given(st.integers(1, 31), st.lists(st.integers(0, (1 << 31) - 1), max_size=80), st.data())
@settings(max_examples=80, deadline=None)
def test_packing_round_trips_from_any_place(width, values, data):
    ids = np.array([v & ((1 << width) - 1) for v in values], np.uint32)
    packed = token_store.pack(ids, width)
    assert len(packed) == (len(ids) * width + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_store.unpack(packed, width, a, b).tolist() == ids[a:b].tolist()


def test_files_hold_what_the_library_encodes(spark, frame):
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(frame(ODD), path, WORDS, 49_408, 2, block_ids=50)
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, ids))
        start += len(ids)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=repr) == sorted(want, key=repr)
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) for r in rows)])[:-1].tolist()
    digests = {r.start: (r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, path).collect()}
    assert digests == {r.start: (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}
    assert spark.read.parquet(path).select(F.max("width")).first()[0] == 16


def test_added_tokens_in_a_text_are_what_the_library_gives():
    tokenizer, words = Tokenizer.from_file(WORDS), token_store.WordIds(WORDS, special=True)
    for text in ("a<|endoftext|>B c", "<|startoftext|> x <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "É<|startoftext|>É!", "plain Text."):
        got = np.frombuffer(token_store.encoded(words, text.encode()), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_an_empty_table_writes_no_document(spark, frame):
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(frame([]), path, WORDS, 49_408)
    assert token_store.read_tokens(spark, path).collect() == []
