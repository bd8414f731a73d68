"""Repeated passages: windows of words whose sequence starts earlier somewhere.

1. Every window is routed by its anchor, the least hash of its runs of ``ANCHOR``
   words, so equal windows meet and no document meets all others.  Consecutive
   windows of one anchor travel as one segment.
2. Segments of equal content fold to the earliest, in the task and then by
   (anchor, content); the others repeat it whole.  An anchor of a single segment
   is settled.
3. The segments of anchors that hold several are indexed per shard: a suffix
   array, its Burrows-Wheeler transform in a wavelet tree of bit-packed levels,
   and backward search, which streams each segment from its end and keeps the
   interval of the current match, cut back to a window's length.  A window whose
   interval holds an earlier position is repeated.  Anchors of more words than a
   shard, by a full count, are not indexed: their windows are grouped by digest,
   folded before the shuffle to the earliest, and the rows of later copies meet it
   by broadcast where a window is frequent.
4. What is repeated goes back to the documents, whose other words stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WordHashes, gram_hashes, mixed, utf8
from plumbline.session import materialize

#: Words of a window, and of the runs that anchors are chosen from.
WINDOW, ANCHOR = 20, 8
SPAN = WINDOW - ANCHOR + 1
#: Documents that show which anchors are hot (they only decide how segments are spread), and the share that makes one.
SAMPLE_DOCS, HOT_SHARE = 2000, 0.02
#: Words of a shard's index; documents folded together in a task.
SHARD_WORDS, TOGETHER = 300_000, 256
#: Windows broadcast with their earliest place are those of at least this part of all windows of large anchors.
FREQUENT_PART = 10_000
#: Order of null doc_ids: last.
LAST = (1 << 63) - 1


# ---- segments


def sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours."""
    width, out = 1, x
    while 2 * width <= span:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = span - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows (at most SPAN), anchor, content hash, and whether a window repeats in the document."""
    windows = gram_hashes(words, WINDOW)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    anchors = sliding_least(gram_hashes(words, ANCHOR), SPAN)
    new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(new, len(windows)))
    if sizes.max() > SPAN:
        pieces = -(-sizes // SPAN)
        new = np.repeat(new, pieces) + SPAN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.diff(np.append(new, len(windows)))
    inside = (np.arange(len(windows)) - np.repeat(new, sizes)).astype(np.uint64)
    content = np.add.reduceat(mixed(windows + inside * np.uint64(0xD6E8FEB86659FD93)), new)
    ordered = np.sort(windows)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    own = np.add.reduceat(np.isin(windows, repeated), new) > 0 if len(repeated) else np.zeros(len(new), bool)
    return new, sizes, anchors[new], content, own


_SEGMENT = "part long, fold boolean, anchor long, content long, own boolean, doc_id long, uid long, start int, n int"


def _segments(hot):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments to compare by anchor, and (``fold``) copies of earlier ones of the task, spread by document."""
        hashes, spread = WordHashes(), np.sort(np.array(hot.value, np.int64))
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(i, TOGETHER)
                parts, counts = [], []
                for raw in batch["text"].to_pylist():
                    split = raw.split()
                    parts.append(segments(hashes.of(split, len(split))))
                    counts.append(len(parts[-1][0]))
                start, n, anchor, content, own = (np.concatenate(x) for x in zip(*parts, strict=True))
                anchor, content = anchor.view(np.int64), content.view(np.int64)
                doc, uid = (np.repeat(batch[c].to_numpy(), counts) for c in ("doc_id", "uid"))
                order = np.lexsort((start, uid, doc, content, anchor))
                start, n, anchor, content, own, doc, uid = (x[order] for x in (start, n, anchor, content, own, doc, uid))
                fold = np.zeros(len(order), bool)
                fold[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                wide = np.isin(anchor, spread) if len(spread) else np.zeros(len(order), bool)
                part = np.where(fold, uid, np.where(wide, anchor ^ content, anchor))
                anchor, content = np.where(fold, 0, anchor), np.where(fold, uid, content)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(fold), pa.array(anchor), pa.array(content), pa.array(own), pa.array(doc), pa.array(uid),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["part", "fold", "anchor", "content", "own", "doc_id", "uid", "start", "n"],
                )

    return find


def _settled(hot):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of (fold, anchor, content, place): copies, and segments still to compare (``open``)."""
        spread = np.sort(np.array(hot.value, np.int64))
        names = ["fold", "anchor", "content", "own", "doc_id", "uid", "start", "n"]
        held = {c: np.zeros(0, np.int64) for c in names}
        last = seen = None  # the last row's anchor and content; the anchor already known to hold several
        for batch in batches:
            b = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
            if not batch.num_rows:
                continue
            b = {c: np.concatenate([held[c].astype(b[c].dtype), b[c]]) for c in names}
            fold, anchor, content = b["fold"], b["anchor"], b["content"]
            first = np.ones(len(anchor), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            if last is not None and not len(held["n"]):
                first[0] = (anchor[0], content[0]) != last
            copy = fold | ~first
            group = np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]).astype(np.int64)]))
            several = np.bincount(group, first & ~fold)[group] > 1
            if seen is not None:
                several |= anchor == seen
            if len(spread):
                several |= np.isin(anchor, spread)
            state = np.where(copy, 1, np.where(several | b["own"], 2, 0))
            # A lone segment of the last anchor waits for the next batch, which may bring another.
            wait = np.flatnonzero((group == group[-1]) & (state == 0) & ~fold)
            held = {c: v[wait] for c, v in b.items()}
            last = (anchor[-1], content[-1])
            seen = None if fold[-1] or len(wait) else anchor[-1]
            out = np.flatnonzero(state > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b["uid"][out]), pa.array(b["doc_id"][out]), pa.array(b["start"][out].astype(np.int32)), pa.array(b["n"][out].astype(np.int32)),
                 pa.array(anchor[out]), pa.array(state[out] == 2)],
                ["uid", "doc_id", "start", "n", "anchor", "open"],
            )

    return settle


# ---- the index


class WaveletTree:
    """Ranks of symbols in a sequence: one bit-packed level for each bit of a symbol, high bits first."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels, self.n = [], len(values)
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])[:-1]
            zeros = self.n - int(ones.sum())
            self.levels.append((packed, before, zeros, bit))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def ranks(self, symbols: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of the places ``at``, counted from the symbol's first place below."""
        places = list(at)
        low = np.zeros(len(symbols), np.int64)
        for packed, before, zeros, bit in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            for k, x in enumerate([*places, low]):
                word = x >> 6
                ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                moved = np.where(one, zeros + ones, x - ones)
                if k < len(places):
                    places[k] = moved
                else:
                    low = moved
        return [x - low for x in places]


class FMIndex:
    """Of words as small numbers (0 between segments), for patterns of up to ``2 ** rounds`` words."""

    def __init__(self, text: np.ndarray, rounds: int = 5) -> None:
        n = len(text)
        rank, keep = text.astype(np.int64), []
        for r in range(rounds):
            keep.append(rank)
            second = np.concatenate([rank[1 << r :], np.full(min(n, 1 << r), -1, np.int64)])
            both = rank * (n + 2) + second + 1
            order = np.argsort(both, kind="stable")
            step = np.concatenate([[0], (both[order][1:] != both[order][:-1]).astype(np.int64)])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
        self.order, self.ranks_by_length = order, keep
        self.bits = max(1, int(text.max()).bit_length())
        self.tree = WaveletTree(np.concatenate([text[-1:], text[:-1]])[self.order], self.bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])

    def back(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more word in front."""
        a, b = self.tree.ranks(symbols, low, high)
        return self.first[symbols] + a, self.first[symbols] + b

    def grouped(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix in order, the interval of those that share its first ``length`` words."""
        n, at, same = len(self.order), 0, np.ones(max(0, len(self.order) - 1), bool)
        for r in range(len(self.ranks_by_length) - 1, -1, -1):
            if length >> r & 1:
                shifted = np.concatenate([self.ranks_by_length[r][at:], np.full(min(n, at), -1, np.int64)])[self.order]
                same &= shifted[1:] == shifted[:-1]
                at += 1 << r
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.diff(np.append(starts, n))
        low = np.repeat(starts, sizes)
        return low, low + np.repeat(sizes, sizes)


def repeated_windows(contents: list[np.ndarray]) -> list[int]:
    """For each segment, in order of place, the bits of its windows that also start earlier.

    The matching statistics of every segment against the index of all: from its
    end, a word at a time, for all segments at once.
    """
    sizes = np.array([len(c) for c in contents])
    flat = np.concatenate(contents)
    vocabulary, ids = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    text[np.repeat(starts, sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ids + 1
    index = FMIndex(text)
    short_low, short_high = index.grouped(WINDOW - 1)
    places = np.append(index.order, len(text))
    mask = np.zeros(len(contents), np.int64)
    low, high = np.zeros(len(contents), np.int64), np.full(len(contents), len(text), np.int64)
    for step in range(int(sizes.max())):
        live = np.flatnonzero(sizes > step)
        at = ends[live] - 1 - step
        if step >= WINDOW:  # one word longer than a window: forget the last
            a = low[live]
            low[live], high[live] = short_low[a], short_high[a]
        low[live], high[live] = index.back(low[live], high[live], text[at])
        if step >= WINDOW - 1:
            a, b = low[live], high[live]
            many = np.flatnonzero(b - a > 1)
            if len(many):
                earliest = np.minimum.reduceat(places, np.stack([a[many], b[many]], axis=1).ravel())[::2]
                hit = live[many[earliest < at[many]]]
                mask[hit] |= np.int64(1) << (sizes[hit] - 1 - step).astype(np.int64)
    return mask.tolist()


# ---- the job


_CONTENT = "key long, doc_id long, uid long, start int, words binary"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of open segments."""
    hashes = WordHashes()
    for batch in batches:
        out: list[tuple] = []
        for doc, uid, raw, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "uid", "text", "found")), strict=True):
            split = raw.split()
            words = hashes.of(split, len(split))
            out += [(s["anchor"], doc, uid, s["start"], words[s["start"] : s["start"] + s["n"] + WINDOW - 1].tobytes()) for s in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc_id", "uid", "start", "words"])


_WINDOW = "same binary, doc_id long, uid long, start int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of open segments, each as a 128-bit digest of its words."""
    hashes = WordHashes()
    for batch in batches:
        out: list[tuple] = []
        for doc, uid, raw, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "uid", "text", "found")), strict=True):
            split = raw.split()
            words = hashes.of(split, len(split)).tobytes()
            for s in found:
                out += [(xxhash.xxh3_128_digest(words[8 * at : 8 * (at + WINDOW)]), doc, uid, at) for at in range(s["start"], s["start"] + s["n"])]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["same", "doc_id", "uid", "start"])


def _later_windows(windows: DataFrame) -> DataFrame:
    """(uid, start, mask) of the windows that also start earlier.

    Equal windows fold before the shuffle, and no task gets all copies of one: a
    frequent window's earliest place is broadcast (at most FREQUENT_PART of them),
    and what is left has few rows a window.
    """
    windows = materialize(windows, "windows")
    place = F.struct("doc_id", "uid", "start")
    first = materialize(windows.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    least = max(1000, -(-windows.count() // FREQUENT_PART))
    frequent = F.broadcast(first.where(F.col("n") >= least))
    often = windows.join(frequent, "same")
    seldom = windows.join(F.broadcast(first.where(F.col("n") >= least).select("same")), "same", "left_anti")
    both = often.unionByName(seldom.join(first.where(F.col("n") < least), "same"))
    return both.where(place != F.col("first")).select("uid", "start", F.lit(1).cast("long").alias("mask"))


def _indexed(shard_words: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key and place, in shards that never part a key; a key holds at most ``shard_words``."""
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "uid", "start", "words")), strict=True):
                if held > shard_words and row[0] != last:
                    yield _marked(rows)
                    rows, held = [], 0
                last = row[0]
                rows.append(row)
                held += len(row[3]) // 8
        if rows:
            yield _marked(rows)

    return indexed


def _marked(rows: list[tuple]) -> pa.RecordBatch:
    marks = repeated_windows([np.frombuffer(r[3], np.uint64) for r in rows])
    hit = [(r[1], r[2], m) for r, m in zip(rows, marks, strict=True) if m]
    columns = list(zip(*hit, strict=True)) or [()] * 3
    kinds = (pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "start", "mask"])


def covered(n: int, marks: list[dict]) -> np.ndarray:
    """Which of ``n`` words some marked window covers."""
    edge = np.zeros(n + 1, np.int64)
    for m in marks:
        mask, at = m["mask"], m["start"]
        while mask:
            if mask & 1:
                edge[at] += 1
                edge[min(n, at + WINDOW)] -= 1
            mask >>= 1
            at += 1
    return np.cumsum(edge[:-1]) > 0


def _kept(keep_text: bool):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, bodies = [], [], []
            for raw, marks in zip(batch["text"].to_pylist(), batch["marks"].to_pylist(), strict=True):
                words = raw.split()
                n.append(len(words))
                if marks:
                    out = covered(len(words), marks)
                    removed.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    removed.append(0)
                bodies.append(b" ".join(words))
            last = pa.array(bodies, pa.binary()) if keep_text else pa.array([hashlib.sha256(b).hexdigest() for b in bodies])
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), last], ["uid", "doc_id", "n_words", "n_removed", "kept"])

    return kept


def _hot_anchors(rows: DataFrame, sample_docs: int, share: float) -> list[int]:
    """Anchors in more than ``share`` of a sample of documents: at most as many as a document has, over ``share``."""
    chosen = rows.select("uid", F.xxhash64("uid").alias("place")).orderBy("place", "uid").limit(sample_docs).select("uid")
    sampled = rows.join(F.broadcast(chosen), "uid").select("doc_id", "uid", "text")
    none = rows.sparkSession.sparkContext.broadcast([])
    anchors = sampled.mapInArrow(_segments(none), _SEGMENT).where(~F.col("fold")).select("anchor", "uid").distinct()
    least = max(2, int(share * sample_docs))
    return [r[0] for r in anchors.groupBy("anchor").count().where(F.col("count") >= least).select("anchor").collect()]


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True,
    sample_docs: int = SAMPLE_DOCS, hot_share: float = HOT_SHARE, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per input row: uid, doc_id, n_words, n_removed, kept.

    Words are what lies between blanks, unchanged; null has none.  A word is
    removed if it lies in a window of 20 words whose sequence also starts earlier:
    in a smaller doc_id (null is largest; of repeated ids the first row is
    smallest), or before it in the same text.  Windows are judged on the input.
    ``kept`` is the words that stay joined by one space, as bytes, or with
    ``keep_text=False`` their SHA-256 in hex.  Texts under 20 words stay whole; an
    empty table gives an empty result; other columns are not read.  Words are
    compared by 64-bit hashes.  ``docs`` is read more than once and must give the
    same rows each time, as files do.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"),
        F.col(doc_id).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("uid"),
        utf8(text).alias("text"),
    )
    hot = sc.broadcast(_hot_anchors(rows, sample_docs, hot_share))
    found = rows.select("doc_id", "uid", "text").mapInArrow(_segments(hot), _SEGMENT)
    place = ("fold", "anchor", "content", "doc_id", "uid", "start")
    dealt = found.repartition("part").sortWithinPartitions(*place).drop("part")
    settled = materialize(dealt.mapInArrow(_settled(hot), "uid long, doc_id long, start int, n int, anchor long, open boolean"), "segments")

    # Large anchors are at most all words by shard_words.
    opened = settled.where("open")
    large = opened.groupBy("anchor").agg(F.sum(F.col("n") + WINDOW - 1).alias("words")).where(F.col("words") > shard_words)
    large = F.broadcast(materialize(large.select("anchor"), "large"))

    def texts(segments: DataFrame) -> DataFrame:
        still = segments.groupBy("uid").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("found"))
        return rows.select("doc_id", "uid", "text").join(still, "uid")

    words = texts(opened.join(large, "anchor", "left_anti")).mapInArrow(_contents, _CONTENT)
    shards = words.repartition("key").sortWithinPartitions("key", "doc_id", "uid", "start")
    marked = materialize(shards.mapInArrow(_indexed(shard_words), "uid long, start int, mask long"), "marked")
    marked = marked.union(_later_windows(texts(opened.join(large, "anchor", "left_semi")).mapInArrow(_windows, _WINDOW)))

    whole = settled.where(~F.col("open")).select("uid", "start", (F.expr("shiftleft(1L, n)") - 1).alias("mask"))
    marks = whole.union(marked).groupBy("uid").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    both = rows.select("uid", "id", "text").join(marks, "uid", "left").select("uid", "id", "text", "marks")
    kind = "binary" if keep_text else "string"
    return both.mapInArrow(_kept(keep_text), f"uid long, doc_id long, n_words long, n_removed long, kept {kind}")
