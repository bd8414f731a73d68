"""Ranked lexical search by Block-Max MaxScore over sharded, compressed inverted indexes.

    index = build_index(docs, path)        every term of every whole text
    search(index, items, k)                the k best documents of each item

A shard is some 16 MB of documents, numbered from 0.  Its index has one row per
term, whose posting list is cut into blocks of 128:

    heads      per block: its last document, and where its bytes and its impacts end
    impacts    per block: the (tf, length) pairs that no other pair of the block beats
    postings   per posting: gap and tf as byte-aligned numbers; a block starts from 0

and one row (term null) for its documents: ids and lengths.  Impacts are kept as
pairs, not as scores, because a score depends on how many documents there are: an
index stays right when further shards are written beside it.

A search keeps a heap per item.  In each range of documents, the lists with the
least bounds whose bounds add up to less than the heap's last score are not
essential: a document that only they hold cannot enter.  Documents of the essential
lists are candidates; block maxima of the other lists reject most of them before
any block of those is unpacked.  A task carries its heaps from shard to shard, and
the heaps of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import utf8
from plumbline.session import materialize

#: Bytes of text in a shard (a longer text has one of its own), postings in a block, bytes of items searched at once.
SHARD_BYTES, BLOCK, ITEM_BYTES = 16 << 20, 128, 4 << 20
#: Documents of a range: the first is small, so that the heap fills early; each next is twice as long.
FIRST_RANGE, LAST_RANGE = 512, 8192

INDEX = "shard long, term binary, n long, total long, heads binary, impacts binary, postings binary, doc_ids array<long>, lengths array<int>"

#: ASCII letters lower-cased, digits and all bytes beyond ASCII kept, all else blank.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 50 + (50 * lengths.astype(np.int64) * n_docs) // max(1, n_terms)


def impacts_of(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers, seven bits each, the high bit set but in a number's last byte; and where each starts."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k)
        out[starts[some] + k] = ((values[some] >> (7 * k)) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, starts


def unpack_numbers(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    within = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * within), starts)


class Numbers(dict):
    """Strings numbered in the order they come."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class _Shard:
    """Documents on their way into one shard's index."""

    def __init__(self, number: int) -> None:
        self.number, self.held = number, 0
        self.terms = Numbers()
        self.columns: list[tuple[np.ndarray, np.ndarray]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        found = terms_of(raw)
        if not found:
            return
        counts = Counter(found)
        ids = np.fromiter(map(self.terms.__getitem__, counts), np.int32, len(counts))
        self.columns.append((ids, np.fromiter(counts.values(), np.int32, len(counts))))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(found))
        self.held += len(raw)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.doc_ids:
            return
        lengths = np.array(self.lengths, np.int32)
        blank = pa.array([None], pa.binary())
        lists = [pa.array([x], t) for x, t in ((self.doc_ids, pa.list_(pa.int64())), (lengths, pa.list_(pa.int32())))]
        whole = [pa.array([v], pa.int64()) for v in (len(lengths), int(lengths.sum()))]
        yield _batch([pa.array([self.number], pa.int64()), blank, *whole, blank, blank, blank, *lists])

        term = np.concatenate([ids for ids, _ in self.columns])
        order = np.argsort(term, kind="stable")  # documents ascend within a term
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), [len(ids) for ids, _ in self.columns])[order]
        tf = np.concatenate([n for _, n in self.columns])[order]
        term = term[order]
        self.columns = []

        df = np.bincount(term, minlength=len(self.terms))
        list_starts = np.concatenate([[0], np.cumsum(df)])
        within = np.arange(len(term)) - list_starts[term]
        first = within % BLOCK == 0
        gap = np.where(first, doc, doc - np.concatenate([doc[:1], doc[:-1]]))
        packed, at = pack_numbers(np.stack([gap, tf], axis=1).ravel())

        block = np.cumsum(first) - 1
        block_starts = np.append(np.flatnonzero(first), len(term))
        list_blocks = np.concatenate([[0], np.cumsum((df + BLOCK - 1) // BLOCK)])
        # Of a block's pairs, by falling tf, one is kept if its document is shorter than all before.
        length = lengths[doc].astype(np.int64)
        order = np.lexsort((length, -tf, block))
        falling = length[order] - block[order] * (int(lengths.max()) + 1)  # each block starts below the one before
        least = np.minimum.accumulate(falling)
        best = order[np.concatenate([[True], falling[1:] < least[:-1]])]
        pairs = np.stack([tf[best], length[best]], axis=1).astype("<i4")
        pair_ends = np.cumsum(np.bincount(block[best], minlength=len(block_starts) - 1))

        owner = np.repeat(np.arange(len(df)), np.diff(list_blocks))  # the list of each block
        pair_base = np.concatenate([[0], pair_ends])[list_blocks]
        byte_base = at[2 * list_starts]
        heads = np.stack(
            [doc[block_starts[1:] - 1], at[2 * block_starts[1:]] - byte_base[owner], pair_ends - pair_base[owner]], axis=1
        ).astype("<i4")
        n, names = len(df), list(self.terms)
        occurrences = np.diff(np.concatenate([[0], np.cumsum(tf, dtype=np.int64)])[list_starts])
        for a in range(0, n, 50_000):
            b = min(n, a + 50_000)
            blobs = [
                _binaries(heads, list_blocks[a : b + 1], 12),
                _binaries(pairs, pair_base[a : b + 1], 8),
                _binaries(packed, byte_base[a : b + 1], 1),
            ]
            yield _batch(
                [pa.array(np.full(b - a, self.number)), pa.array(names[a:b], pa.binary()), pa.array(df[a:b].astype(np.int64)),
                 pa.array(occurrences[a:b]), *blobs, *(pa.nulls(b - a, pa.list_(t)) for t in (pa.int64(), pa.int32()))]
            )


def _binaries(values: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    """Rows ``bounds[i]`` to ``bounds[i + 1]`` of ``values``, ``width`` bytes each, as one binary per i."""
    offsets = ((bounds - bounds[0]) * width).astype(np.int32)
    data = np.ascontiguousarray(values[bounds[0] : bounds[-1]]).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "total", "heads", "impacts", "postings", "doc_ids", "lengths"])


def _index(shard_bytes: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        shard = _Shard(base)
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = raw.as_py()
                if shard.held and shard.held + len(raw) > shard_bytes:
                    yield from shard.batches()
                    shard = _Shard(shard.number + 1)
                shard.add(doc_id, raw)
        yield from shard.batches()

    return index


def build_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the index of every whole text under ``path`` and read it back.

    Null and empty texts, and others without a term, are in no shard.  Repeated rows
    are documents each; null ids stay null.  An empty table writes an index without
    rows.  Columns other than the two named are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    rows.mapInArrow(_index(shard_bytes), INDEX).write.option("compression", "zstd").parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


class _List:
    """A term's posting list in a shard: block maxima at hand, blocks unpacked when asked for."""

    def __init__(self, w: int, n: int, heads: bytes, impacts: bytes, postings: bytes, lengths: np.ndarray, stats: tuple[int, int]) -> None:
        heads_ = np.frombuffer(heads, "<i4").reshape(-1, 3)
        pairs = np.frombuffer(impacts, "<i4").reshape(-1, 2)
        self.w, self.raw, self.lengths, self.stats = w, np.frombuffer(postings, np.uint8), lengths, stats
        self.last, self.byte_ends = heads_[:, 0], heads_[:, 1]
        scores = w * impacts_of(pairs[:, 0], norms(pairs[:, 1], *stats))
        self.maxima = np.maximum.reduceat(scores, np.concatenate([[0], heads_[:-1, 2]]))
        self.bound = int(self.maxima.max())
        # Ascending from the start: a packed block holds its last document all over.
        self.docs, self.scores = np.repeat(self.last, BLOCK)[:n], np.zeros(n, np.int64)
        self.unpacked = np.zeros(len(heads_), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        """Make the postings of these ascending blocks readable."""
        blocks = blocks[~self.unpacked[blocks]]
        if not len(blocks):
            return
        ends = self.byte_ends[blocks]
        starts = np.where(blocks, self.byte_ends[blocks - 1], 0)
        raw = np.concatenate([self.raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]) if len(blocks) < len(self.last) else self.raw
        numbers = unpack_numbers(raw).reshape(-1, 2)
        sizes = np.minimum(BLOCK, len(self.docs) - blocks * BLOCK)
        first = np.cumsum(sizes) - sizes
        docs = np.cumsum(numbers[:, 0])
        # Every block starts from 0 again: take off what the sum holds from the blocks before.
        docs -= np.repeat(docs[first] - numbers[first, 0], sizes)
        to = np.repeat(blocks * BLOCK - first, sizes) + np.arange(len(docs))
        self.docs[to] = docs
        self.scores[to] = self.w * impacts_of(numbers[:, 1], norms(self.lengths[docs], *self.stats))
        self.unpacked[blocks] = True

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``a`` to before ``b`` and their scores."""
        first, last = np.searchsorted(self.last, [a, b - 1])
        last = min(int(last), len(self.last) - 1)
        if first > last:
            return self.docs[:0], self.scores[:0]
        self.unpack(np.arange(first, last + 1))
        docs = self.docs[first * BLOCK : (last + 1) * BLOCK]
        i, j = np.searchsorted(docs, [a, b])
        return docs[i:j], self.scores[first * BLOCK : (last + 1) * BLOCK][i:j]

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that would hold each document; one beyond the last where none can."""
        return np.searchsorted(self.last, docs)

    def of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Scores of these ascending documents of these blocks; 0 where the list lacks one."""
        self.unpack(np.unique(blocks))
        at = np.searchsorted(self.docs, docs)
        return np.where(self.docs[at] == docs, self.scores[at], 0)


class Heap:
    """The k best documents so far: highest score, then smallest doc_id, null last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores = k, np.zeros(0, np.int64)
        self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document under this score cannot enter; one that equals it may."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= max(1, self.least)
        scores = np.concatenate([self.scores, scores[good]])
        ids, null = np.concatenate([self.ids, ids[good]]), np.concatenate([self.null, null[good]])
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]


def search_shard(heap: Heap, lists: list[_List], ids: np.ndarray, null: np.ndarray) -> None:
    """Offer ``heap`` every document of a shard that can enter it."""
    lists = sorted((x for x in lists if x.bound > 0), key=lambda x: x.bound)
    bounds = np.cumsum([x.bound for x in lists])
    a, step = 0, FIRST_RANGE
    while lists and a < len(ids):
        if bounds[-1] < heap.least:
            return
        b = min(len(ids), a + step)
        least = heap.least
        split = int(np.searchsorted(bounds, least))  # lists before it add up to less than ``least``
        total = np.zeros(b - a, np.int64)
        for x in lists[split:]:
            docs, scores = x.between(a, b)
            total[docs - a] += scores
        docs = np.flatnonzero(total)
        scores, docs = total[docs], docs + a
        if split and len(docs):
            scores, docs = _complete(scores, docs, lists[:split], least)
        heap.offer(scores, ids[docs], null[docs])
        a, step = b, min(LAST_RANGE, 2 * step)


def _complete(scores: np.ndarray, docs: np.ndarray, others: list[_List], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that can still reach ``least``, with their scores in the other lists added."""
    blocks = np.stack([x.block_of(docs) for x in others])
    most = np.stack([np.append(x.maxima, 0)[at] for x, at in zip(others, blocks, strict=True)])
    rest = np.cumsum(most, axis=0)  # what a list and those with lesser bounds can add
    for j in range(len(others) - 1, -1, -1):
        alive = scores + rest[j] >= least
        scores, docs, blocks, most, rest = scores[alive], docs[alive], blocks[:, alive], most[:, alive], rest[:, alive]
        held = np.flatnonzero(most[j])
        if len(held):
            scores[held] += others[j].of(docs[held], blocks[j, held])
    return scores, docs


def _search(items: list[list[bytes]], weights: dict[bytes, int], stats: tuple[int, int], k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in items]
        shard, ids, null, lengths = None, None, None, None
        lists: dict[bytes, _List] = {}

        def finish() -> None:
            for heap, terms in zip(heaps, items, strict=True):
                if found := [lists[t] for t in terms if t in lists]:
                    search_shard(heap, found, ids, null)

        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:  # the first row of a shard
                    if shard is not None:
                        finish()
                    shard, lists = row["shard"], {}
                    null = np.array([i is None for i in row["doc_ids"]])
                    ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
                    lengths = np.array(row["lengths"], np.int64)
                else:
                    t = row["term"]
                    lists[t] = _List(weights[t], row["n"], row["heads"], row["impacts"], row["postings"], lengths, stats)
        if shard is not None:
            finish()
        for number, heap in enumerate(heaps):
            if len(heap.scores):
                columns = [pa.array(np.full(len(heap.scores), number, np.int32)), pa.array(heap.ids, mask=heap.null), pa.array(heap.scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return search


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in blocks of at most ``most`` bytes of text (a longer text alone)."""
    block, held = [], 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), utf8(text).alias("t")).toLocalIterator():
        if block and held + len(row.t) > most:
            yield block
            block, held = [], 0
        block.append((row.i, list(dict.fromkeys(terms_of(bytes(row.t))))))
        held += len(row.t) + 64
    if block:
        yield block


RANKED = "item_id long, rank int, doc_id long, score long"


def search(
    index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item, from 1.

    Scores above 0 only, equal ones by ascending doc_id (null last).  An item is a
    row: repeated items are ranked each, an item without a term (null or empty text)
    or without a hit has no row; null ids stay.  An empty index or table gives no row.
    Items are a query set against all documents: blocks of ``item_bytes`` are sent to
    every task and searched one after the other; what leaves a task is ``k`` rows an item.
    """
    spark = index.sparkSession
    whole = index.where("term IS NULL").agg(F.sum("n"), F.sum("total")).first()
    stats = (whole[0] or 0, whole[1] or 0)
    out = []
    for block in _blocks(items, item_id, text, item_bytes):
        names = {t for _, terms in block for t in terms}
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in names], "term binary"))
        df = index.where("term IS NOT NULL").select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("n"))
        weights = {bytes(t): weight(stats[0], n) for t, n in df.collect()}
        lists = index.join(wanted.withColumn("wanted", F.lit(True)), "term", "left").where("wanted OR term IS NULL").drop("wanted")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_shard = lists.repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
        by_shard = by_shard.select("shard", "term", "n", "heads", "impacts", "postings", "doc_ids", "lengths")
        found = by_shard.mapInArrow(_search([terms for _, terms in block], weights, stats, k), "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long"))
        out.append(materialize(best.join(ids, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    result = spark.createDataFrame([], RANKED)
    for part in out:
        result = result.union(part)
    return result
