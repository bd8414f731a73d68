"""Exact, passage and near duplicates against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import exact_dedup, near_dedup, substring_dedup
from plumbline.llm.common import WordHashes

BLANK = re.compile(r"[\x20\x09-\x0D]")


def tidy(text):
    return BLANK.sub("", text or "")


# ---- exact


def brute_groups(pairs):
    groups = {}
    for k, (i, t) in enumerate(pairs):
        groups.setdefault(tidy(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for body, rows in groups.items():
        best = min(rows)
        for row in rows:
            out[row[3]] = (pairs[best[3]][0], len(rows), hashlib.sha256(body.encode()).hexdigest())
    return out


EXACT = [
    (5, "a b c"), (3, "abc"), (9, " a bc\n"), (1, "ab c"), (2, None), (4, ""), (7, " \t\x0b"), (8, "abcd"),
    (None, "abc"), (8, "abcd"), (10, "é x"), (11, "éx"), (12, "long" * 60_000), (13, "long " * 60_000),
]


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_exact_groups_match_brute_force(frame, budget):
    rows = exact_dedup.exact_groups(frame(EXACT), fold_bytes=budget, own_bytes=budget).collect()
    want = Counter(brute_groups(EXACT).values())
    assert Counter((r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_exact_on_an_empty_table(frame):
    assert exact_dedup.exact_groups(frame([])).collect() == []
    assert exact_dedup.drop_exact_copies(frame([])).collect() == []


def test_exact_copies_drop_with_all_columns(saved):
    docs = saved(EXACT)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tidy(r.text)[:9] for r in kept.collect()) == sorted({tidy(t): tidy(t)[:9] for _, t in EXACT}.values())


@given(st.lists(st.binary(max_size=6), max_size=60), st.sampled_from([1 << 20, 700]))
@settings(max_examples=60, deadline=None)
def test_trie_groups(keys, budget):
    found = dict(exact_dedup.PatriciaTrie(budget).groups((k, i) for i, k in enumerate(keys)))
    assert found == {i: keys.index(k) for i, k in enumerate(keys)}


# ---- passages


def brute_repeats(pairs):
    split = [(t or "").encode().split() for _, t in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0, k))
    first, out = {}, []
    for k in order:
        for s in range(len(split[k]) - 19):
            first.setdefault(tuple(split[k][s : s + 20]), (k, s))
    for k in range(len(pairs)):
        gone = set()
        for s in range(len(split[k]) - 19):
            if first[tuple(split[k][s : s + 20])] != (k, s):
                gone |= set(range(s, s + 20))
        kept = b" ".join(w for at, w in enumerate(split[k]) if at not in gone)
        out.append((pairs[k][0], len(split[k]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    some = lambda n: " ".join(word() for _ in range(n))
    shared, rest = some(60), []
    rest += [(k, f"{some(rng.randint(0, 40))} {shared} {some(rng.randint(0, 40))}") for k in range(60)]
    rest += [(100 + k, " ".join(shared.split()[k : k + 30])) for k in range(20)]
    rest += [(200, "x " * 400), (201, "x y " * 300), (202, "y x " * 50), (203, "x " * 19), (204, "x " * 20), (205, "x\t" * 21)]
    rest += [(300, None), (301, ""), (302, " \n"), (303, "one"), (None, shared), (None, some(30)), (400, shared + " " + shared)]
    rng.shuffle(rest)
    return rest


@pytest.mark.parametrize("hot_share, shard_words", [(0.02, 300_000), (0.9, 200)])
def test_repeats_match_brute_force(saved, hot_share, shard_words):
    pairs = passages()
    docs = saved(pairs, files=3)
    rows = substring_dedup.without_repeats(docs, keep_text=False, hot_share=hot_share, shard_words=shard_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr) == brute_repeats(pairs)


def test_no_index_holds_more_than_two_shards(saved, monkeypatch):
    """A passage of many documents amid different text, which no sample of documents shows."""
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = some(24)
    pairs = [(k, f"{some(30)} {shared} {some(30)}") for k in range(120)]
    whole = substring_dedup.repeated_windows

    def small(contents):
        if sum(map(len, contents)) > 800:
            raise MemoryError("one index of a hot window")
        return whole(contents)

    monkeypatch.setattr(substring_dedup, "repeated_windows", small)
    for share in (0.9, 0.02):
        rows = substring_dedup.without_repeats(saved(pairs), keep_text=False, hot_share=share, shard_words=400).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr) == brute_repeats(pairs)


def test_repeats_of_repeated_rows_and_empty_tables(saved):
    text = " ".join(map(str, range(40)))
    rows = substring_dedup.without_repeats(saved([(1, text), (1, text)])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 40]
    assert sorted(bytes(r.kept).decode() for r in rows) == ["", text]
    assert substring_dedup.without_repeats(saved([])).collect() == []


@given(st.lists(st.lists(st.integers(1, 3), min_size=20, max_size=32), min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_index_finds_what_starts_earlier(contents):
    first = {}
    want = []
    for k, c in enumerate(contents):
        mask = 0
        for s in range(len(c) - 19):
            mask |= (first.setdefault(tuple(c[s : s + 20]), (k, s)) != (k, s)) << s
        want.append(mask)
    assert substring_dedup.repeated_windows([np.array(c, np.uint64) for c in contents]) == want


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 500)
    tree = substring_dedup.WaveletTree(values, 6)
    at = rng.integers(0, 501, 200)
    symbols = rng.integers(0, 37, 200)
    (got,) = tree.ranks(symbols, at)
    assert got.tolist() == [int((values[:a] == s).sum()) for a, s in zip(at, symbols, strict=True)]


# ---- near copies


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.random()}"
    return " ".join(words)


def test_near_copies_meet_and_others_do_not(saved):
    rng = random.Random(3)
    pairs, group = [], {}
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for v in range(rng.randint(1, 15)):
            i = len(pairs)
            pairs.append((i, " ".join(words) if v == 0 else edited(words, 2, rng)))
            group[i] = g
    pairs += [(1000, None), (1001, ""), (1002, "only four words here"), (1003, "only  four words\there"), (None, "nobody")]
    rows = near_dedup.near_classes(saved(pairs)).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    for i, g in group.items():
        assert classes[i] == min(k for k in group if group[k] == g)
    assert classes[1001] == classes[1000] == 1000 and classes[1003] == 1002 and classes[None] is None
    assert sum(r.kept for r in rows) == 12 + 3
    assert {r.doc_id: r.class_size for r in rows}[1003] == 2


def test_a_large_group_around_one_text_is_one_class(saved):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    pairs = [(k, edited(words, 4, rng)) for k in range(150)] + [(900, " ".join(words))]
    rows = near_dedup.near_classes(saved(pairs)).collect()
    assert {r.class_id for r in rows} == {0} and rows[0].class_size == 151


def test_near_copies_of_repeated_rows_and_empty_tables(saved):
    docs = saved([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "q r s t u v w")])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert near_dedup.near_classes(saved([])).collect() == []


def test_families_on_one_template_are_found(saved):
    """Many pairs of which each is alike and all the others are nearly so; brute force is the judge."""
    rng = random.Random(12)
    template = [f"t{k}" for k in range(240)]
    pairs = []
    for f in range(150):
        own = [f"f{f}w{k}" for k in range(42)]
        for copy in range(2):
            words = template + own
            if copy:
                words[rng.randrange(250, 270)] = f"x{f}"
                words[rng.randrange(10, 220)] = f"y{f}"
            pairs.append((2 * f + copy, " ".join(words)))
    texts = {i: t.encode().split() for i, t in pairs}
    words, docs = WordHashes(), saved(pairs)
    idf = near_dedup.inverse_frequencies(docs.select(near_dedup.utf8("text").alias("text")), 5)
    vectors = {}
    for i, t in texts.items():
        grams, tf = near_dedup.shingles(words.of(t, len(t)), 5)
        vectors[i] = grams, near_dedup.weigh(grams, tf, idf)
    alike = {(i, j) for i in texts for j in texts if i < j and near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= near_dedup.SIMILARITY}
    assert alike == {(2 * f, 2 * f + 1) for f in range(150)}
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert classes == {i: i - i % 2 for i in texts}


def test_texts_on_one_template_do_not_all_meet(saved, monkeypatch):
    """Frequent shingles, which a few counters cannot tell from rare ones, bring no pairs together."""
    rng = random.Random(21)
    template = [f"t{k}" for k in range(240)]
    pairs = []
    for f in range(60):
        words = template + [f"f{f}w{k}" for k in range(42)]
        pairs += [(2 * f, " ".join(words)), (2 * f + 1, " ".join([*words[:260], f"x{rng.random()}", *words[261:]]))]
    met, compared, joined = [], near_dedup._compared, near_dedup.links_of_classes

    def counted(pairs, *rest):
        met.append(pairs.count())
        return compared(pairs, *rest)

    def between(*settings):
        del met[:]
        return joined(*settings)

    monkeypatch.setattr(near_dedup, "COUNTERS", 16)
    monkeypatch.setattr(near_dedup, "_compared", counted)
    monkeypatch.setattr(near_dedup, "links_of_classes", between)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(saved(pairs)).collect()}
    assert classes == {i: i - i % 2 for i in classes} and len(classes) == 120
    assert len(met) == 1 and met[0] <= 120  # of 7,140


def test_links_between_classes_match_all_pairs(spark):
    """Chains of edited texts in one bucket, each text its own class: the links are those of brute force."""
    rng, words, rows = random.Random(8), WordHashes(), []
    for chain in range(6):
        text = [f"c{chain if chain % 2 else 'x'}w{rng.randrange(300)}" for _ in range(120)]
        for _ in range(12):
            rows.append(" ".join(text).encode())
            for _ in range(rng.choice([0, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"n{rng.random()}"
    rows.append(b"few words")
    weights, vectors = np.random.default_rng(2).uniform(0.75, 1, 64), []
    for text in rows:
        grams, tf = near_dedup.shingles(words.of(text.split(), len(text.split())), 5)
        vectors.append((grams, near_dedup.weigh(grams, tf, weights)))
    n = len(rows)
    want = {(i, j) for i in range(n) for j in range(i) if near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8}
    assert 60 < len(want) < n * n / 4
    bodies = spark.createDataFrame([*enumerate(rows)], "uid long, body binary")
    buckets = spark.createDataFrame([([7], i, leader) for i in range(n) for leader in (0, n - 1)], "set array<long>, uid long, leader long")
    labels, done = (spark.createDataFrame([], schema) for schema in ("uid long, label long", "uid long, leader long"))
    found = near_dedup.links_of_classes(buckets, labels, bodies, done, 0.8, 5, spark.sparkContext.broadcast(weights)).collect()
    assert {(max(r), min(r)) for r in found} == want


def test_samples_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.sort(np.concatenate([a[:250], rng.integers(0, 1 << 62, 50).astype(np.uint64)]))
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    want = near_dedup.weighted_jaccard((a, wa), (b, wb))
    tables = near_dedup.draws()
    sa = near_dedup.weighted_samples(a, wa, np.array([0]), 2000, tables)
    sb = near_dedup.weighted_samples(b, wb, np.array([0]), 2000, tables)
    assert abs((sa == sb).mean() - want) < 0.05


def test_components_join_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "uid long, leader long")
    got = {r.uid: r.label for r in near_dedup.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_word_hashes_forget_and_stay_right():
    h = WordHashes(3 * (WordHashes.OWN + 1) * WordHashes.SHARE)
    words = [b"a", b"b", b"c", b"d", b"a"] * 100 + [b"x" * 10_000]
    got = h.of(words, 501)
    assert got[0] == got[4] and len(set(got.tolist())) == 5 and b"x" * 10_000 not in h
    tight = WordHashes(64 * 160)
    tight.of([str(k).encode() for k in range(1000)], 1000)
    assert 0 < len(tight) <= 64 and tight.held <= 64 * 160


def test_unique_long_words_stay_within_the_bytes():
    from plumbline.llm import byte_bpe, lm_scoring, token_store
    import public_tokenizers as public

    ranks = public.path("byte_bpe_multi_50k.tiktoken")
    held = [WordHashes(1 << 20), lm_scoring.Speller(ranks, 1 << 20), byte_bpe.Pieces(byte_bpe.ranks_of(ranks)), token_store.WordIds(public.path("word_bpe_49k.json"))]
    for cache in held:
        cache.most_bytes = 1 << 20
        for k in range(150):
            word = f"{k}z" * 3000
            cache[word if isinstance(cache, byte_bpe.Pieces) else word.encode()]
        assert cache.held <= 1 << 20 and sum(len(k) for k in cache) <= 1 << 20
