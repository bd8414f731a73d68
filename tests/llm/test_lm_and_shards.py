"""Language-model scores and sharding against brute force, and their edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm_scoring, sharding
from plumbline.llm.common import fractions_of

SUBWORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "and", "Rain", "falls", "on", "hills,", "slowly."] + [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(5, 60)):
            text += ["the", "rain", "falls"] if rng.random() < 0.3 else [rng.choice(words)]
        rows.append((i, " ".join(text)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus() + [(900, None), (901, ""), (None, "the rain"), (3, "the rain"), (902, "x" * 20_000), (903, "É ü")]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n int, score string")
    out = lm_scoring.score_texts(docs, fractions_of("doc_id", 10) == 0, SUBWORDS, sample=600, sample_docs=100, most_frequent=40)
    return rows, out.collect()


def lowered(text):
    return [*(text or "").encode().translate(lm_scoring.LOWER).split(), b""]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


def test_base_scores_match_brute_force(scored):
    rows, out = scored
    counts = Counter(w for i, t in rows if not held(i) for w in lowered(t))
    n = sum(counts.values())
    total = n + 0.1 * (len(counts) + 1)
    want = []
    for i, t in rows:
        words = lowered(t)
        base = sum(math.log10((counts[w] + 0.1) / total) for w in words)
        want.append((str(i), held(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)


def test_held_out_texts_are_likelier_under_the_model(scored):
    rows, out = scored
    part = [r for r in out if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in part) > sum(r.base_score for r in part)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def tiny_model(seed=0):
    rng = np.random.default_rng(seed)
    pairs = rng.random((lm_scoring.END + 1, lm_scoring.END + 1))
    model = lm_scoring.Attention.untrained(pairs / pairs.sum(axis=1, keepdims=True))
    for k in "CS":
        model.weights[k] = rng.normal(0, 0.3, model.weights[k].shape).astype(np.float32)
    return model


def test_probabilities_add_up_and_look_back_only():
    model = tiny_model()
    rng = np.random.default_rng(1)
    head = rng.integers(0, lm_scoring.SUBWORDS, 70)
    total = 0.0
    for last in range(lm_scoring.END + 1):
        total += math.exp(model.score(np.append(head, last).astype(np.int32), np.array([71]))[0][-1])
    assert total == pytest.approx(1, abs=1e-3)
    a = model.score(head.astype(np.int32), np.array([70]))[0]
    b = model.score(np.append(head, [5, 6]).astype(np.int32), np.array([72]))[0]
    assert np.allclose(a, b[:70], atol=1e-5)


def test_documents_of_a_batch_do_not_see_each_other():
    model = tiny_model()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, lm_scoring.SUBWORDS, n).astype(np.int32) for n in (1, 100, 33, 64)]
    apart = np.concatenate([model.score(d, np.array([len(d)]))[0] for d in docs])
    assert np.allclose(apart, model.score(np.concatenate(docs), np.array([len(d) for d in docs]))[0], atol=1e-5)


def test_classes_hold_subwords_that_begin_words_or_others():
    ranks, ids, classes = lm_scoring.subword_ids(SUBWORDS)
    token = {int(ids[r]): t for t, r in ranks.items()}
    assert len(token) == len(ranks) > 950 and max(token) < lm_scoring.SUBWORDS
    assert all((t[:1] == b" ") == (i // lm_scoring.CLASS < classes) for i, t in token.items())
    assert all(bytes([b]) in ranks for b in range(256))


def closed_spellings(speller, alphabet, most):
    """Words of these letters up to a length, by their subwords."""
    from itertools import product

    words = [b"", *(bytes(w) for n in range(1, most + 1) for w in product(alphabet, repeat=n))]
    return words, [np.frombuffer(speller[w], "<u2").astype(np.int32) for w in words]


def test_words_add_up_to_one_at_most():
    """After any text, the words of a closed alphabet have at most probability 1 together."""
    speller = lm_scoring.Speller(SUBWORDS)
    words, spelled = closed_spellings(speller, b"ab", 7)
    size = lm_scoring.END + 1
    pairs = np.full((size, size), 1e-9)
    for ids in spelled:  # a law that knows these words alone
        for a, b in zip(np.append(ids[:-1], lm_scoring.END), np.append(ids[1:], ids[0]), strict=True):
            pairs[a, b] += 0.5 ** len(ids)
        pairs[ids[-1], lm_scoring.END] += 0.1
        pairs[lm_scoring.END, ids[0]] += 1
    for model in (lm_scoring.Attention.untrained(pairs / pairs.sum(axis=1, keepdims=True)), tiny_model()):
        for head in ([], [b"ab"], [b"ba", b"a", b"abab"]):
            total = 0.0
            for word in words:
                text = [*head, word] if word == b"" else [*head, word, b""]
                ids, sizes = lm_scoring.spelled(text, speller)
                log_p = lm_scoring.word_log_p(model, ids, sizes, np.array([0]), speller.classes)
                total += math.exp(log_p[len(head)])
            assert total <= 1 + 1e-4
    # A text's words multiply to its subwords' probability, given that it begins as a text does.
    ids, sizes = lm_scoring.spelled([b"ab", b"bab", b"a", b""], speller)
    log_p, begins = model.score(ids, np.array([len(ids)]), speller.classes)
    words = lm_scoring.word_log_p(model, ids, sizes, np.array([0]), speller.classes)
    assert words.sum() == pytest.approx(log_p.sum() - begins[0], rel=1e-5)


def test_scores_do_not_depend_on_partitions(spark):
    rows, found = corpus(120, 5), []
    for n in (1, 4, 11):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        out = lm_scoring.score_texts(docs, fractions_of("doc_id", 10) == 0, SUBWORDS, sample=300, sample_docs=60).collect()
        found.append({r.doc_id: r.score for r in out})
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-4)


def test_a_window_of_32_sees_its_first_subword():
    model = tiny_model()
    ids = np.random.default_rng(4).integers(0, lm_scoring.SUBWORDS, 40).astype(np.int32)
    other = ids.copy()
    other[0] += 1 if ids[0] < lm_scoring.SUBWORDS - 1 else -1
    a, b = (model.score(x, np.array([40]))[0] for x in (ids, other))
    assert (np.abs(a - b)[1:32] > 0).all()


def test_word_order_is_learnt_from_all_training_documents(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "c d", " a  b ", ""] * 50)], "uid long, text string")
    counted = docs.mapInArrow(lm_scoring._corpus_counts(SUBWORDS), "word binary, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    words = counted.where("pair is null").select("word", "n")
    assert {bytes(r.word): r.n for r in words.collect()} == {b"a": 100, b"b": 100, b"c": 50, b"d": 50, b"": 200}
    speller = lm_scoring.Speller(SUBWORDS)
    one = lambda w, at: int(lm_scoring.spelled([w], speller)[0][at])
    want, size = Counter(), lm_scoring.END + 1
    for text, n in (([b"a", b"b"], 100), ([b"c", b"d"], 50), ([], 50)):
        for x, y in zip([b"", *text], [*text, b""], strict=True):
            want[one(x, -1) * size + one(y, 0)] += n
    across = counted.where("pair is not null")
    assert {r.pair: r.n for r in across.collect()} == want
    shares = lm_scoring.pair_shares(words, across.select("pair", "n"), SUBWORDS)
    assert np.allclose(shares.sum(axis=1), 1)
    assert shares[one(b"a", -1), one(b"b", 0)] > 3 * shares[one(b"c", -1), one(b"b", 0)]


def test_the_fit_reads_a_share_of_windows_that_grows(spark):
    rows, read = corpus(400), []
    for n in (100, 400):
        model, docs = tiny_model(), spark.createDataFrame([(i, t.encode()) for i, t in rows[:n]], "doc_id long, text binary")
        before = {k: w.copy() for k, w in model.weights.items()}
        read.append(lm_scoring.fit_share(model, docs, SUBWORDS, share=2))
        assert all(model.weights[k].shape == w.shape and not np.array_equal(model.weights[k], w) for k, w in before.items())
    assert read[1] > 2 * read[0] > 0


def test_the_model_is_fitted_on_every_window_of_all_training_documents(spark, monkeypatch):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t, i % 10 == 0) for i, t in rows], "doc_id long, text string, held_out boolean")
    speller = lm_scoring.Speller(SUBWORDS)
    sizes = [len(lm_scoring.spelled(lm_scoring.words_of(t.encode()), speller)[0]) for i, t in rows if i % 10]
    windows = sum(math.ceil(n / lm_scoring.STRIDE) for n in sizes)
    read, plain = [], lm_scoring.fit_share
    monkeypatch.setattr(lm_scoring, "fit_share", lambda *a, **b: read.append(plain(*a, **b)))
    lm_scoring.score_texts(docs, F.col("held_out"), SUBWORDS)
    assert read == [windows] and windows > 180


def test_windows_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(lm_scoring, "WINDOWS_AT_ONCE", 16)
    texts, seeds = [t.encode() for _, t in corpus(150)] + [b"", b"x y " * 400], [(k * 0x9E3779B9) ** 2 % 2**64 - 2**63 for k in range(152)]
    made = list(lm_scoring._training_windows(SUBWORDS)([pa.record_batch([pa.array(texts, pa.binary()), pa.array(seeds, pa.int64())], ["text", "seed"])]))
    assert max(b.num_rows for b in made) <= 16
    speller, want, n = lm_scoring.Speller(SUBWORDS), [], lm_scoring.CONTEXT + lm_scoring.STRIDE
    for text, seed in zip(texts, seeds, strict=True):
        ids = lm_scoring.spelled(lm_scoring.words_of(text), speller)[0].tolist()
        for k, first in enumerate(range(0, len(ids), lm_scoring.STRIDE)):
            at = range(first - lm_scoring.CONTEXT - 1, first + lm_scoring.STRIDE)
            there = [0 <= i < len(ids) for i in at]
            row = [ids[i] if ok else lm_scoring.END for i, ok in zip(at, there, strict=True)]
            want.append(((seed + 0x9E3779B97F4A7C15 * (k + 1)) % 2**63, row, there[1:]))
    windows, valid = lm_scoring._windows_of([r for b in made for r in b["row"].to_pylist()])
    assert windows.shape[1] == n + 1
    places = [p for b in made for p in b["place"].to_pylist()]
    assert [*zip(places, windows.tolist(), valid.tolist(), strict=True)] == want


def test_gradients_match_differences():
    model = tiny_model()
    rng = np.random.default_rng(3)
    n = lm_scoring.CONTEXT + lm_scoring.STRIDE
    windows, valid = rng.integers(0, lm_scoring.SUBWORDS, (3, n + 1)).astype(np.int32), np.ones((3, n), bool)
    valid[0, :4] = False

    def loss():
        scored = valid[:, lm_scoring.CONTEXT :]
        z = model.forward(windows[:, :-1], valid)["z"][scored]
        last, goal = windows[:, lm_scoring.CONTEXT : -1][scored], windows[:, 1 + lm_scoring.CONTEXT :][scored]
        return -float(model.outputs(z, last, goal)[0].astype(float).mean())

    for k, g in model.gradients(windows, valid).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = model.weights[k][at]
        model.weights[k][at] = kept + 1e-2
        up = loss()
        model.weights[k][at] = kept - 1e-2
        down = loss()
        model.weights[k][at] = kept
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.03, abs=1e-4), k


def test_steps_use_their_memory_again():
    """Steps of any size after one another are those of new models, and ask for little memory."""
    import tracemalloc

    model, rng = tiny_model(), np.random.default_rng(6)
    n = lm_scoring.CONTEXT + lm_scoring.STRIDE
    for size in (lm_scoring.BATCH, 5, 200, lm_scoring.BATCH):
        windows, valid = rng.integers(0, lm_scoring.SUBWORDS, (size, n + 1)).astype(np.int32), np.ones((size, n), bool)
        valid[::3, :4] = False
        tracemalloc.start()
        found = model.gradients(windows, valid)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        fresh = lm_scoring.Attention(model.class_prior, model.id_prior, model.weights).gradients(windows, valid)
        assert all((found[k] == fresh[k]).all() for k in fresh)
    assert most < 12 << 20


def test_steps_take_no_log_probabilities(monkeypatch):
    """A step needs the softmaxes of the targets' log probabilities alone, and these are the same without them."""
    model, rng = tiny_model(), np.random.default_rng(7)
    n = 50
    z = np.tanh(rng.normal(size=(n, lm_scoring.WIDTH))).astype(np.float32)
    last, target = rng.integers(0, lm_scoring.SUBWORDS, (2, n))
    whole, bare = (model.outputs(z, last, target, loss=loss) for loss in (True, False))
    assert bare[0] is None and all((a == b).all() for a, b in zip(whole[1:], bare[1:], strict=True))
    windows = rng.integers(0, lm_scoring.SUBWORDS, (9, lm_scoring.CONTEXT + lm_scoring.STRIDE + 1)).astype(np.int32)
    valid = np.ones((9, windows.shape[1] - 1), bool)
    valid[2, :4] = valid[5, 20:] = False
    want = model.gradients(windows, valid)
    monkeypatch.setattr(np, "log", None)
    assert all((want[k] == g).all() for k, g in model.gradients(windows, valid).items())


def test_windows_that_lack_positions_do_not_touch_others():
    model, rng = tiny_model(), np.random.default_rng(8)
    before = rng.integers(0, lm_scoring.SUBWORDS, (6, lm_scoring.CONTEXT + lm_scoring.STRIDE)).astype(np.int32)
    valid = np.ones(before.shape, bool)
    valid[0, : lm_scoring.CONTEXT] = valid[3, 30:] = valid[5, 9:] = False
    for states in (lambda b, v: model.forward(b, v)["z"], model.states):
        together = states(before, valid)
        for k in range(len(before)):
            assert np.allclose(together[k], states(before[k : k + 1], valid[k : k + 1])[0], atol=1e-6)
        other = np.where(valid, before, (before + 1) % lm_scoring.SUBWORDS)  # what does not exist is not read
        there = valid[:, lm_scoring.CONTEXT :]
        assert np.allclose(together[there], states(other, valid)[there], atol=1e-6)


def test_scores_without_training_rows_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = lm_scoring.score_texts(docs, F.lit(True), SUBWORDS).collect()
    assert {r.train_tokens for r in out} == {0} and {r.n_known for r in out} == {0}
    assert lm_scoring.score_texts(docs.limit(0), F.lit(False), SUBWORDS).collect() == []


# ---- sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 24, 100, 1000, 4099])
def test_places_are_a_permutation(spark, n):
    place = sharding.feistel(spark, n).place(F.col("id"))
    places = [r[0] for r in spark.range(n).select(place.alias("p")).collect()]
    assert sorted(places) == list(range(n))
    assert n < 100 or places != sorted(places)


def plain_place(x, n):
    a, b = sharding.Feistel(n).sides
    while True:
        left, right = divmod(x, b)
        for i, (m, c) in enumerate(sharding.KEYS):
            f = (right % sharding.PRIME * m + c) % sharding.PRIME
            left, right = right, (left + f * f % sharding.PRIME) % (a if i % 2 == 0 else b)
        x = left * b + right
        if x < n:
            return x


def test_shards_match_plain_arithmetic(frame, spark):
    rng = random.Random(1)
    pairs = [(i, "é" * rng.randint(0, 30)) for i in rng.sample(range(10_000), 500)]
    rows = sharding.shard_rows(frame(pairs)).collect()
    number = {i: k for k, (i, _) in enumerate(sorted(pairs))}
    text = dict(pairs)
    for r in rows:
        place = plain_place(number[r.doc_id], 500)
        raw = text[r.doc_id].encode()
        assert (r.shard, r.slot) == (place % 24, place // 24)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    again = sharding.shard_rows(frame(pairs[::-1]).repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_of_odd_rows_have_no_gap(frame):
    pairs = [(None, "a")] * 30 + [(1, None)] * 30 + [(1, "")] * 30 + [(2, "b" * 100_000)]
    rows = sharding.shard_rows(frame(pairs)).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 91 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_rows(frame([])).collect() == []
