"""Conversations as training texts of a token budget, with the spans that are learnt.

    windows = format_chats(turns)      texts with their loss spans
    read_turns(windows)                the turns again, from the texts alone

A window is the conversation's system turn (if its first turn is one), some of the
turns before, and new turns.  Prefix sums of the turns' tokens choose it: the new
turns are as many as the budget holds after the rest, and the history as many of
the last turns as its own limit allows.  Every turn is new in exactly one window,
whole; only assistant texts that are new count for the loss, so none is learnt twice.

A conversation is cut into segments of 4,096 turns whose windows are independent but
for the history, so one that holds a third of all rows is spread like any other data.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import bounded, materialize

#: Turns of a segment; bytes of text a task reads ahead before it chooses windows.
SEGMENT, AHEAD_BYTES = 4096, 8 << 20


@dataclass(frozen=True)
class Template:
    """Marks of turns by role, and how texts that hold such marks are told apart from them.

    A mark is a control string, perhaps with white space around it.  In a text, every
    control string gets a backslash after its first character, one more where there are
    some already; reading takes one off.  As no control string holds or overlaps
    another, marks are the only control strings of a formatted text.
    """

    #: role -> (before, after); other roles stand between ``other`` marks, the role's name on the first line.
    marks: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>\n", "\n<</SYS>>\n\n"),
        ("user", "[INST] ", " [/INST]"),
        ("assistant", "<s> ", " </s>"),
    )
    other: tuple[str, str] = ("[ROLE] ", " [/ROLE]")
    #: The role that is learnt.
    target: str = "assistant"

    def __post_init__(self) -> None:
        words = self.controls
        for a in words:
            if len(a) < 2 or "\\" in a or len(a.split()) != 1:
                raise ValueError(f"{a!r} cannot be a control string")
            for b in words:
                if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        if len({before for _, before, _ in self.marks} | {self.other[0]}) <= len(self.marks):
            raise ValueError("two roles open with the same mark")

    @property
    def controls(self) -> list[str]:
        return sorted({m.strip() for _, *pair in self.marks for m in pair} | {m.strip() for m in self.other})

    def _pattern(self, slashes: str) -> re.Pattern:
        return re.compile("|".join(re.escape(c[0]) + rf"(?=(\\{slashes}){re.escape(c[1:])})" for c in self.controls))

    def escaper(self):
        """(escape, plain): a function that hides control strings in a text, and its inverse."""
        hide, show = self._pattern("*"), self._pattern("+")
        firsts = {c[0] for c in self.controls}

        def escape(text: str) -> str:
            return hide.sub(lambda m: m.group() + "\\", text) if any(f in text for f in firsts) else text

        def plain(text: str) -> str:
            if "\\" not in text:
                return text
            out, at = [], 0
            for m in show.finditer(text):
                out.append(text[at : m.end()])
                at = m.end() + 1
            return "".join(out) + text[at:]

        return escape, plain

    def writer(self):
        """A function of role and text: the formatted turn and where its text lies in it."""
        escape, _ = self.escaper()
        marks = {role: (a, b) for role, a, b in self.marks}

        def write(role: str, text: str) -> tuple[str, int, int]:
            if role in marks:
                before, after = marks[role]
            else:
                before, after = self.other[0] + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n", self.other[1]
            body = escape(text)
            return before + body + after, len(before), len(before) + len(body)

        return write

    def reader(self):
        """A function of a formatted text: role, text, and where the escaped text lies, of every turn."""
        _, plain = self.escaper()
        opened = {a: (role, b) for role, a, b in self.marks} | {self.other[0]: (None, self.other[1])}

        def read(text: str) -> list[tuple[str, str, int, int]]:
            turns, at = [], 0
            while at < len(text):
                mark = next(m for m in opened if text.startswith(m, at))
                role, after = opened[mark]
                start = at + len(mark)
                if role is None:
                    line = text.index("\n", start)
                    role = plain(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text[start:line]))
                    start = line + 1
                # The first control string after the start is the closing mark's own.
                stop = text.index(after.strip(), start) - (len(after) - len(after.lstrip()))
                turns.append((role, plain(text[start:stop]), start, stop))
                at = stop + len(after)
            return turns

        return read


def spans(costs: np.ndarray, budget: int, head: int, start: int, least: int, history_turns: int, history_tokens: int) -> Iterator[tuple[int, int, int]]:
    """(history from, new from, new to) of the windows from turn ``start`` on, by prefix sums of ``costs``.

    ``head`` tokens of the system turn count in every window; history never goes
    before turn ``least``.  A new turn that has no room even alone gets a window alone.
    """
    total = np.concatenate([[0], np.cumsum(costs)])
    room = budget - head
    while start < len(costs):
        back = int(np.searchsorted(total, total[start] - history_tokens))
        # History gives way where the next turn would not fit beside it.
        fits = int(np.searchsorted(total, total[start + 1] - room))
        back = min(start, max(back, fits, start - history_turns, least))
        stop = max(start + 1, int(np.searchsorted(total, total[back] + room, "right")) - 1)
        yield back, start, stop
        start = stop


WINDOW = (
    "conv_id long, first_turn long, n_turns int, n_repeated int, n_tokens long, over_budget boolean, text string, "
    "loss array<struct<start: int, stop: int>>"
)
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_WINDOW = pa.schema(
    [("conv_id", pa.int64()), ("first_turn", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()),
     ("over_budget", pa.bool_()), ("text", pa.string()), ("loss", _LOSS)]
)


class _Open:
    """A segment of a conversation, of which the turns still needed are held."""

    def __init__(self, key: tuple, limits: tuple[int, int, int]) -> None:
        self.key, self.limits, self.system = key, limits, None
        #: Formatted turns, the place of the first of them, and how many are history already.
        self.turns: list[tuple] = []
        self.first = self.done = self.held = 0

    def add(self, row: dict, turn: tuple) -> None:
        if row["kind"] == 0:
            self.system = turn
            return
        if not self.turns and row["position"] is not None:
            self.first = row["position"]
        if not self.turns and not self.first and row["role"] == "system":
            self.system = turn
        self.turns.append(turn)
        self.held += len(turn[0])
        if row["kind"] == 1:
            self.done = len(self.turns)

    def windows(self, final: bool) -> Iterator[dict]:
        """Windows of the turns at hand; before the end the last stays open, as more turns may fit."""
        budget, history_turns, history_tokens = self.limits
        head, costs = 0, np.array([t[3] for t in self.turns], np.int64)
        own = bool(self.system) and self.first == 0 and self.turns[0] is self.system
        if self.system:
            head = self.system[3]
            costs[:1] *= not own  # counted in every window already
        found = list(spans(costs, budget, head, self.done, int(own), history_turns, history_tokens))
        for back, start, stop in found if final else found[:-1]:
            repeated = ([self.system] if self.system and not (own and start == 0) else []) + self.turns[back:start]
            at, loss = sum(len(t[0]) for t in repeated), []
            for text, a, b, _, learnt in self.turns[start:stop]:
                if learnt:
                    loss.append({"start": at + a, "stop": at + b})
                at += len(text)
            shown = repeated + self.turns[start:stop]
            tokens = sum(t[3] for t in shown)
            yield {
                "conv_id": None if self.key[0] else self.key[1], "first_turn": self.first + start, "n_turns": stop - start,
                "n_repeated": len(repeated), "n_tokens": tokens, "over_budget": tokens > budget,
                "text": "".join(t[0] for t in shown), "loss": loss,
            }
            self.done = stop
        drop = max(0, self.done - history_turns)
        self.turns, self.first, self.done, self.held = self.turns[drop:], self.first + drop, self.done - drop, 0


def _windows(template: Template, ranks: str, pattern: str, limits: tuple[int, int, int]):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            mergeable = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=mergeable, special_tokens={}).encode_ordinary
        write = template.writer()
        segment: _Open | None = None
        out: list[dict] = []
        held = 0

        def ready() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_pylist(out, _WINDOW)
            out.clear()
            held = 0
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["null"], row["conv_id"], row["segment"])
                if segment is None or segment.key != key:
                    if segment is not None:
                        out += segment.windows(final=True)
                        held += segment.held
                    segment = _Open(key, limits)
                text, a, b = write(row["role"], row["text"])
                segment.add(row, (text, a, b, len(encode(text)), row["role"] == template.target))
                held += len(text)
                if segment.held > AHEAD_BYTES:
                    out += segment.windows(final=False)
                if held > AHEAD_BYTES:
                    yield ready()
        if segment is not None:
            out += segment.windows(final=True)
        yield ready()

    return windows


def turn_order() -> list:
    """Turns of equal number go by role, then by a hash of the text, which is short enough to be a bound of ranges."""
    return ["turn", "role", F.xxhash64("text")]


def positions(turns: DataFrame) -> DataFrame:
    """The rows with ``position``, their place in the conversation; no conversation passes through one task.

    Rows are sorted by range over all tasks and written once; a row's place is its
    place in its file and what files before hold of its conversation.
    """
    order = ["null", "conv_id", *turn_order()]
    rows = turns.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)  # equal rows are spread as well
    rows = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    parts = rows.groupBy("part", "null", "conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("null", "conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = rows.join(parts, ["part", "null", "conv_id"]).withColumn("position", F.col("before") + F.col("at") - F.col("first"))
    return placed.select(*turns.columns, "position")


def format_chats(
    turns: DataFrame, ranks: str, pattern: str, budget: int = 1024, history_turns: int = 4, history_tokens: int = 256,
    template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT,
) -> DataFrame:
    """A row per window: conv_id, first_turn, n_turns, n_repeated, n_tokens, over_budget, text, loss.

    ``first_turn`` is the place in the conversation, from 0, of the first of ``n_turns``
    new turns; ``n_repeated`` turns stand before them: the system turn and the history.
    ``loss`` holds the code points of the text, from start to before stop, of every new
    assistant text.  Tokens are counted turn by turn with the byte-level BPE of ``ranks``,
    marks included.  A window is over the budget only if one turn and the system turn are.

    Rows are ordered by turn (null first), then role, then a hash of the text; repeated
    rows are turns each.  A null role or text counts as empty; rows of null conv_id are one conversation
    whose id is null; an empty table gives an empty result.  Texts are never cut.
    Columns other than the four named are not read.
    """
    rows = turns.select(
        F.col(conv_id).isNull().alias("null"),
        F.coalesce(F.col(conv_id).cast("long"), F.lit(0)).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    key, segment = ["null", "conv_id"], max(segment, history_turns + 1)
    columns = [*key, "segment", "kind", "position", "turn", "role", "text"]
    short = rows.withColumns({"segment": F.lit(0).cast("long"), "kind": F.lit(2), "position": F.lit(None).cast("long")})
    # Conversations of more turns than a segment: few, as each stands for so many rows.
    long_, few = bounded(rows.groupBy(*key).count().where(F.col("count") > segment).select(*key))
    if few and long_.isEmpty():
        every = short.select(columns)
    else:
        long_ = F.broadcast(long_) if few else long_
        placed = positions(rows.join(long_, key, "left_semi")).withColumn("segment", F.floor(F.col("position") / segment))
        history = placed.where(F.col("position") % segment >= segment - history_turns).withColumn("segment", F.col("segment") + 1)
        starts = placed.where((F.col("segment") > 0) & (F.col("position") % segment == 0)).select(*key, "segment")
        systems = placed.where((F.col("position") == 0) & (F.col("role") == "system")).drop("segment").join(starts, key)
        every = short.join(long_, key, "left_anti").select(columns)
        for kind, part in enumerate((systems, history, placed)):
            every = every.union(part.withColumn("kind", F.lit(kind)).select(columns))
    dealt = every.repartition(*key, "segment").sortWithinPartitions(*key, "segment", "kind", "position", *turn_order())
    dealt = dealt.select(*key, "segment", "kind", "position", "role", "text")
    return dealt.mapInArrow(_windows(template, ranks, pattern, (budget, history_turns, history_tokens)), WINDOW)


_TURN = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learnt", pa.string())]
)


def _turns(template: Template):
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, (_, plain) = template.reader(), template.escaper()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                learnt = {s["start"]: plain(row["text"][s["start"] : s["stop"]]) for s in row["loss"]}
                for k, (role, text, start, _) in enumerate(read(row["text"])[row["n_repeated"] :]):
                    turn = {"conv_id": row["conv_id"], "position": row["first_turn"] + k, "role": role, "text": text}
                    out.append(turn | {"learnt": learnt.get(start)})
            yield pa.RecordBatch.from_pylist(out, _TURN)

    return turns


def read_turns(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, position, role and text of every turn, read from the window that has it as new.

    ``learnt`` is the text under the loss mask that begins where the turn's text does, else null.
    """
    schema = "conv_id long, position long, role string, text string, learnt string"
    return windows.select("conv_id", "first_turn", "n_repeated", "text", "loss").mapInArrow(_turns(template), schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_STREAM = pa.schema(
    [("conv_id", pa.int64()), ("first_turn", pa.int64()), ("n_turns", pa.int64()), ("chars", pa.int64()), ("learnt", pa.int64()),
     ("split", pa.int64()), ("bytes", pa.binary())]
)


def _streams(template: Template):
    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each window what its new turns add to the two hashes of its conversation, packed: the second repeats the first."""
        read, (_, plain) = template.reader(), template.escaper()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                turns = read(row["text"])[row["n_repeated"] :]
                whole = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns).encode()
                learnt = "".join(plain(row["text"][s["start"] : s["stop"]]) for s in row["loss"])
                found = {"conv_id": row["conv_id"], "first_turn": row["first_turn"], "n_turns": len(turns), "chars": len(row["text"])}
                out.append(found | {"learnt": len(learnt), "split": len(whole), "bytes": zlib.compress(whole + learnt.encode(), 6)})
            yield pa.RecordBatch.from_pylist(out, _STREAM)

    return streams


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, its windows hashed as they stream by in order."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    schema = pa.schema([(c, pa.string() if "sha" in c else pa.int64()) for c in names])
    out: list[dict] = []
    state = None

    def closed() -> dict:
        conv, n, whole, chars, learnt, size = state
        return dict(zip(names, (conv, n, whole.hexdigest(), chars, learnt.hexdigest(), size), strict=True))

    for batch in batches:
        for at in range(batch.num_rows):
            conv, _, n, size, chars, split, packed = (c[at].as_py() for c in batch.columns)
            if state is None or state[0] != conv:
                if state is not None:
                    out.append(closed())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = zlib.decompress(packed)
            state[1] += n
            state[2].update(raw[:split])
            state[3] += chars
            state[4].update(raw[split:])
            state[5] += size
        yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()
    yield pa.RecordBatch.from_pylist([closed()] if state else [], schema)


def digests(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A hash needs its bytes in order, so the windows of a conversation stream through one
    task, packed, one at a time.
    """
    kind = "conv_id long, first_turn long, n_turns long, chars long, learnt long, split long, bytes binary"
    packed = windows.select("conv_id", "first_turn", "n_repeated", "text", "loss").mapInArrow(_streams(template), kind)
    return packed.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn").mapInArrow(_digests, DIGEST)
