"""Ranked search against scoring every document, its index, and its edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ranked_search

ITEMS = "item_id long, text string, rank int, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        best = []
        for doc, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if c[t]}
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in w)
            if score > 0:
                best.append((-score, doc is None, doc or 0))
        out += [(str(item), r, None if null else doc, -score) for r, (score, null, doc) in enumerate(sorted(best)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "Rain", "hills", "É-ü", "日本語", "x1"] + [f"w{j}" for j in range(120)]
    weights = [60, 40, 20, 10, 5, 5, 5] + [30 / (j + 1) for j in range(120)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[9]), (6, texts[9]), (6, texts[9]), (None, texts[9]), (900, None), (901, ""), (902, "--- !")]
    items = [(j, " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 40])))) for j in range(25)]
    return docs, items + [(3, "the rain"), (None, "w1 w2"), (60, None), (61, ""), (62, "unseen words"), (63, texts[9])]


def frames(spark, frame, docs, items):
    return frame(docs).repartition(5), spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)


@pytest.mark.parametrize(("shard_bytes", "block", "k", "item_bytes"), [(16 << 20, 128, 50, 4 << 20), (9000, 4, 7, 4 << 20), (30_000, 16, 3, 300), (1, 128, 5, 4 << 20)])
def test_ranks_match_scoring_every_document(spark, frame, tmp_path, monkeypatch, shard_bytes, block, k, item_bytes):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "FIRST_RANGE", 4)
    docs, items = corpus()
    d, b = frames(spark, frame, docs, items)
    index = ranked_search.build_index(d, str(tmp_path / "index"), shard_bytes=shard_bytes)
    out = ranked_search.search(index, b, k, item_bytes=item_bytes).collect()
    assert sorted([(str(r.item_id), r.rank, r.doc_id, r.score) for r in out], key=repr) == brute(docs, items, k)


def test_blocks_that_cannot_enter_stay_packed():
    rng = random.Random(1)
    shard = ranked_search._Shard(0)
    for i in range(3000):
        shard.add(i, ("common " * rng.randint(1, 3) + ("rare " * 9 if i % 500 == 0 else "") + "filler " * rng.randint(1, 50)).encode())
    rows = [r for b in shard.batches() for r in b.to_pylist()]
    docs, by = rows[0], {r["term"]: r for r in rows[1:]}
    lengths, stats = np.array(docs["lengths"]), (docs["n"], docs["total"])
    w = {t: ranked_search.weight(docs["n"], r["n"]) + 1 for t, r in by.items()}
    lists = [ranked_search._List(w[t], by[t]["n"], by[t]["heads"], by[t]["impacts"], by[t]["postings"], lengths, stats) for t in (b"common", b"rare")]
    heap = ranked_search.Heap(3)
    ranked_search.search_shard(heap, lists, np.arange(3000), np.zeros(3000, bool))
    assert len(heap.scores) == 3 and set(heap.ids) < set(range(0, 3000, 500))
    # The heap holds three documents after two ranges of 512 and 1,024; from there on only blocks with a candidate are unpacked.
    assert lists[0].unpacked[:12].all() and lists[0].unpacked[12:].sum() <= 3
    fresh = ranked_search._List(w[b"common"], 3000, by[b"common"]["heads"], by[b"common"]["impacts"], by[b"common"]["postings"], lengths, stats)
    fresh.unpack(np.arange(len(fresh.last)))
    assert list(fresh.docs) == list(range(3000))
    assert all(fresh.maxima[k] == fresh.scores[128 * k : 128 * k + 128].max() for k in range(len(fresh.last)))


def test_numbers_unpack_to_themselves():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 31) - 1], np.int64)
    packed, starts = ranked_search.pack_numbers(values)
    assert list(ranked_search.unpack_numbers(packed)) == list(values) and len(packed) == starts[-1]


def test_terms_fold_ascii_only():
    assert ranked_search.terms_of("Ab-É x_9 \x7f日Z".encode()) == ["ab".encode(), "É x".encode(), b"9", "日z".encode()]
    for text in ("", "É É", "a" * 100_000, "\x00\x1fA b", "ſK"):
        assert [t.decode() for t in ranked_search.terms_of(text.encode())] == terms(text)


def test_empty_tables_and_very_long_texts(spark, frame, tmp_path):
    d, b = frames(spark, frame, [(1, "a b")], [(1, "a")])
    none = ranked_search.build_index(d.where("doc_id = 5"), str(tmp_path / "none"))
    assert ranked_search.search(none, b).collect() == []
    docs = [(1, "rain " * 200_000 + "hills"), (2, "rain"), (3, "z" * 300_000), (4, "snow")]
    index = ranked_search.build_index(frame(docs), str(tmp_path / "long"))
    items = [(1, "rain hills"), (2, "z" * 300_000)]
    out = ranked_search.search(index, spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS)).collect()
    assert sorted([(str(r.item_id), r.rank, r.doc_id, r.score) for r in out], key=repr) == brute(docs, items, 50)
    assert ranked_search.search(index, b.where("item_id = 5")).collect() == []
