"""Chat windows: templates that read back, spans by brute force, and edge cases."""

import hashlib
import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, position int, n_tokens string"
PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<", "[", "\\", "/", " ", "\n", "s>", "INST]", "é", "a"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a\nb", "[ROLE]\\n"]) | TEXT, TEXT), max_size=6))
@settings(max_examples=400, deadline=None)
def test_formatted_turns_read_back(turns):
    template = chat.Template()
    write, read = template.writer(), template.reader()
    escape, plain = template.escaper()
    whole = "".join(write(role, text)[0] for role, text in turns)
    assert [(role, text) for role, text, _, _ in read(whole)] == turns
    for _, text in turns:
        assert plain(escape(text)) == text and not any(c in escape(text) for c in template.controls)


def test_templates_that_cannot_be_read_are_refused():
    for marks in ((("user", "<u> ", " </u>"), ("bot", "<u> ", " </b>")), (("user", "<u", "u<"),), (("user", "< u>", "</u>"),), (("user", "<u>", "<u>x"),)):
        with pytest.raises(ValueError):
            chat.Template(marks=marks)


def naive(costs, budget, head, history_turns, history_tokens, least):
    """The same windows turn by turn."""
    out, start = [], 0
    while start < len(costs):
        back, stop = start, start
        while back > max(least, start - history_turns, 0) and sum(costs[back - 1 : start]) <= history_tokens:
            back -= 1
        while back < start and head + sum(costs[back : start + 1]) > budget:
            back += 1
        stop = start + 1
        while stop < len(costs) and head + sum(costs[back : stop + 1]) <= budget:
            stop += 1
        out.append((back, start, stop))
        start = stop
    return out


def test_spans_match_a_plain_loop():
    rng = random.Random(3)
    for _ in range(500):
        costs = [rng.randint(1, 40) for _ in range(rng.randint(0, 30))]
        budget, head, turns, tokens = rng.randint(10, 90), rng.randint(0, 30), rng.randint(0, 5), rng.randint(0, 50)
        least = rng.randint(0, 1)
        mine = list(chat.spans(chat.np.array(costs, chat.np.int64), budget, head, 0, least, turns, tokens))
        assert mine == naive(costs, budget, head, turns, tokens, least)


def conversations(seed=2, n=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turns = rng.choice([1, 2, 3, 8, 25])
        first = 1 if rng.random() < 0.5 else 0
        for t in range(turns):
            role = "system" if t == 0 and first else rng.choice(["user", "assistant", "tool", "system"])
            words = " ".join(rng.choice(["rain", "</s>", "[INST] ok", "<\\s>", "hills", "é"]) for _ in range(rng.randint(0, 60)))
            rows.append((conv, t * 2, role, words))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)


def grouped(rows):
    by = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    for conv, _, role, text in sorted(rows, key=key):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


def digest_of(turns):
    learnt = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


@pytest.mark.parametrize(("segment", "ahead"), [(4096, 8 << 20), (3, 8 << 20), (4096, 200), (5, 100)])
def test_windows_hold_every_turn_once(spark, monkeypatch, segment, ahead):
    monkeypatch.setattr(chat, "AHEAD_BYTES", ahead)
    rows = conversations()
    windows = chat.format_chats(frame(spark, rows), RANKS, PATTERN, 200, 2, 60, segment=segment)
    got = windows.collect()
    by = grouped(rows)
    template = chat.Template()
    read = template.reader()
    write, (_, plain) = template.writer(), template.escaper()
    seen = {c: 0 for c in by}
    encode = _encoder()
    for w in sorted(got, key=lambda w: (w.conv_id, w.first_turn)):
        turns, shown = by[w.conv_id], [(r, t) for r, t, _, _ in read(w.text)]
        assert w.first_turn == seen[w.conv_id] and len(shown) == w.n_turns + w.n_repeated
        seen[w.conv_id] += w.n_turns
        assert shown[w.n_repeated :] == turns[w.first_turn : w.first_turn + w.n_turns]
        repeated = shown[: w.n_repeated]
        if turns[0][0] == "system" and w.first_turn:
            assert repeated and repeated.pop(0) == turns[0]
        assert len(repeated) <= 2 and repeated == turns[w.first_turn - len(repeated) : w.first_turn]
        assert w.n_tokens == sum(encode(write(r, t)[0]) for r, t in shown) and w.over_budget == (w.n_tokens > 200)
        assert not w.over_budget or (w.n_turns == 1 and not repeated)
        learnt = [t for r, t in shown[w.n_repeated :] if r == "assistant"]
        assert [plain(w.text[s.start : s.stop]) for s in w.loss] == learnt
    assert seen == {c: len(t) for c, t in by.items()}
    out = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in out.items()} == {c: digest_of(t) for c, t in by.items()}
    assert {c: r.formatted_chars for c, r in out.items()} == {c: sum(len(w.text) for w in got if w.conv_id == c) for c in by}
    if segment == 4096:  # the same windows as a plain loop over each conversation
        for conv, turns in by.items():
            costs = [encode(write(r, t)[0]) for r, t in turns]
            own = turns[0][0] == "system"
            head = costs[0] if own else 0
            want = naive(([0] if own else costs[:1]) + costs[1:], 200, head, 2, 60, int(own))
            assert sorted((w.first_turn, w.first_turn + w.n_turns) for w in got if w.conv_id == conv) == [(a, b) for _, a, b in want]


def _encoder():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(e.encode_ordinary(text))


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "x"), (2, 5, "assistant", "y " * 30_000)]
    windows = chat.format_chats(frame(spark, rows), RANKS, PATTERN, 50)
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert out == {c: digest_of(t) for c, t in grouped(rows).items()}
    assert chat.digests(chat.format_chats(frame(spark, rows).where("conv_id = 9"), RANKS, PATTERN)).collect() == []


def test_a_conversation_of_a_third_of_all_rows_is_spread(spark):
    rows = [(7, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], f"turn {t}") for t in range(400)] + [(c, 0, "user", "a") for c in range(100, 900)]
    windows = chat.format_chats(frame(spark, rows), RANKS, PATTERN, 120, segment=16)
    hot = [w for w in windows.collect() if w.conv_id == 7]
    assert len({w.first_turn // 16 for w in hot}) == 25 and all((w.first_turn + w.n_turns - 1) // 16 == w.first_turn // 16 for w in hot)
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert out == {c: digest_of(t) for c, t in grouped(rows).items()}
