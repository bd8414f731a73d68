"""Benchmark passages in documents, copied or slightly edited.

Distance is edit distance over words (ASCII letters lower-cased, ASCII punctuation
as blanks).  An item is found where some passage is within ``1 - similarity`` of
its length.  Windows of an item's size are embedded by CGK random walks, under
which few edits leave most coordinates equal; a window that agrees with the item
on all sampled coordinates of some table is verified exactly.

Windows are laid only where they can match: if an item of m words has at most d
edits, one of the d + 1 stretches between them keeps (m - d) / (d + 1) words, so
a window that shares no such run of words with the item is not embedded.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WordHashes, fresh, gram_hashes, mixed, utf8
from plumbline.session import materialize

SIMILARITY, LEAST_WORDS = 0.8, 5
#: Walks, tables of each walk, sampled coordinates of a table, steps of a walk for each word.
WALKS, TABLES, COORDINATES, STEPS = 6, 8, 2, 2
#: Bytes of items that one pass carries, and documents that are searched together.
BLOCK_BYTES, TOGETHER = 4 << 20, 256

MATCHES = "array<struct<item_id: long, distance: int, at_word: long>>"
PLAIN = bytes(ord(" ") if chr(b) in string.punctuation else b for b in bytes(range(256)).lower())


def plain_words(raw: bytes) -> list[bytes]:
    return raw.translate(PLAIN).split()


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    edits: int
    run: int


def walk_samples(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """For each window its symbols at the sampled coordinates: tables x coordinates x windows.

    A walk outputs the word it stands on and moves on by a random bit of that word
    and the step; past the window's end it outputs 0.  Coordinates are fractions
    of the walk's length, so windows of a size agree on them.
    """
    rng = np.random.default_rng(97 + walk)
    longest = int(sizes.max()) * STEPS if len(sizes) else 0
    wanted = np.floor(rng.random((TABLES, COORDINATES))[:, :, None] * (sizes * STEPS)).astype(np.int64)
    odd = mixed(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(walk)) | np.uint64(1)
    out = np.zeros(wanted.shape, np.uint64)
    at, last = starts.copy(), starts + sizes
    for step in range(longest):
        inside = at < last
        symbol = np.where(inside, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
        hit = wanted == step
        if hit.any():
            out = np.where(hit, symbol, out)
        at = at + ((symbol * odd[step]) >> np.uint64(63)).astype(np.int64)
    return out


def distance_within(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``words``, and where the first such stretch ends."""
    n = len(words)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


class Searcher:
    """The items of a block, their runs of words, and their samples under each walk."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, least_words: int) -> None:
        self.hashes = WordHashes()
        self.items: list[Item] = []
        for item_id, raw in items:
            words = self.of(raw)
            m = len(words)
            if m < least_words:
                continue
            d = int((1 - similarity) * m + 1e-9)
            self.items.append(Item(item_id, words, d, -(-(m - d) // (d + 1))))
        self.sizes = np.array([len(i.words) for i in self.items], np.int64)
        self.seeds: dict[int, tuple] = {}
        if not self.items:
            return
        for run in sorted({i.run for i in self.items}):
            grams, owner, offset = [], [], []
            for k, item in enumerate(self.items):
                if item.run == run:
                    g = gram_hashes(item.words, run)
                    grams.append(g)
                    owner.append(np.full(len(g), k))
                    offset.append(np.arange(len(g)))
            grams, owner, offset = map(np.concatenate, (grams, owner, offset))
            order = np.argsort(grams, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.seeds[run] = (grams[order], owner[order], offset[order], maybe)
        flat = np.concatenate([i.words for i in self.items])
        starts = np.cumsum([0, *self.sizes])[:-1]
        self.samples = [walk_samples(flat, starts, self.sizes, w) for w in range(WALKS)]

    def of(self, raw: bytes) -> np.ndarray:
        words = plain_words(raw)
        return self.hashes.of(words, len(words))

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and starts of the windows of a document that share a run with the item, in line with it."""
        found = []
        for run, (grams, owner, offset, maybe) in self.seeds.items():
            g = gram_hashes(words, run)
            at = np.flatnonzero(maybe[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
            low, high = np.searchsorted(grams, g[at], "left"), np.searchsorted(grams, g[at], "right")
            count = high - low
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.stack([owner[which], np.repeat(at, count) - offset[which]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    def search(self, texts: list[bytes]) -> list[list[dict]]:
        """The items found in each text, once each, with the least distance and the word where it begins."""
        docs = [self.of(t) for t in texts]
        out: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return out
        parts = [(d, *self.windows(w)) for d, w in enumerate(docs) if len(w)]
        doc = np.concatenate([np.full(len(k), d) for d, k, _ in parts] or [np.zeros(0, np.int64)])
        if not len(doc):
            return out
        item = np.concatenate([k for _, k, _ in parts])
        start = np.concatenate([s for _, _, s in parts])
        flat = np.concatenate(docs)
        base = np.cumsum([0, *map(len, docs)])
        # A window that sticks out of its document begins or ends with it.
        size = self.sizes[item]
        first = np.clip(start, 0, np.maximum(0, np.diff(base)[doc] - size))
        size = np.minimum(size, np.diff(base)[doc])
        near = np.zeros(len(doc), bool)
        for walk in range(WALKS):
            left = np.flatnonzero(~near)
            if not len(left):
                break
            mine = walk_samples(flat, base[doc[left]] + first[left], size[left], walk)
            near[left] = (mine == self.samples[walk][:, :, item[left]]).all(axis=1).any(axis=0)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k in np.flatnonzero(near):
            d, i = int(doc[k]), int(item[k])
            if best.get((d, i), (1, 0))[0] == 0:
                continue
            it = self.items[i]
            low = max(0, int(first[k]) - 2 * it.edits)
            words = docs[d][low : int(first[k]) + len(it.words) + 2 * it.edits]
            distance, end = distance_within(it.words, words)
            if distance <= it.edits and distance < best.get((d, i), (it.edits + 1, 0))[0]:
                best[d, i] = (distance, max(0, low + end - len(it.words)))
        for (d, i), (distance, at) in sorted(best.items()):
            out[d].append({"item_id": self.items[i].item_id, "distance": distance, "at_word": at})
        return out


def _matches(items, similarity: float, least_words: int):
    @F.pandas_udf(MATCHES)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(items.value, similarity, least_words)
        for texts in batches:
            found: list[list[dict]] = []
            for at in range(0, len(texts), TOGETHER):
                found += searcher.search([bytes(t) for t in texts.iloc[at : at + TOGETHER]])
            yield pd.Series(found, index=texts.index, dtype=object)

    return matches


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of so many bytes (a longer one alone), read one partition at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), utf8(text).alias("t")).toLocalIterator():
        if block and held + len(row.t) > most:
            yield block
            block, held = [], 0
        block.append((row.i, bytes(row.t)))
        held += len(row.t)
    if block:
        yield block


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    name: str = "matches", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with the benchmark items that each whole text holds: item_id, distance in words, first word.

    The benchmark is a query set against all rows: each block of ``block_bytes``
    is sent to every task, and between blocks the result is written, so what is
    broadcast has a fixed size.  Items under ``least_words`` words (null and empty
    ones too) match nothing, as chance would find them everywhere; null texts hold
    nothing.  Repeated items are reported apart, repeated rows alike; an empty
    table or benchmark gives no match.  All columns of ``docs`` stay; one called
    ``name`` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.withColumn(name, F.array().cast(MATCHES))
    for n, block in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        if n:
            out = materialize(out, "matched")
        more = _matches(sc.broadcast(block), similarity, least_words)(utf8(text))
        out = out.withColumn(name, more if n == 0 else F.concat(name, more))
    return out


def contaminated(name: str = "matches") -> Column:
    return F.size(name) > 0


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    name = fresh(docs, "benchmark_matches")
    return with_matches(docs, benchmark, name=name, **settings).where(~contaminated(name)).drop(name)
