"""Regression forests on bootstrapped rows, grown level by level from sums over bins.

The method is that of Spark's own forest: every tree draws each row a Poisson(1)
number of times, each feature is cut at most at ``BINS - 1`` quantiles (between all
values where they are few), and every feature is tried at every node.  Spark walks
all trees for one row before it takes the next, so each row and tree touches sums
far apart in memory; here a task takes one tree for a block of rows, whose sums
stay near.

Rows are binned once: a byte for each feature, and the target as a whole number.  A
level takes one job for each slice of open nodes: tasks sum draws and targets by
node, feature and bin, one message for each node and feature; the messages of a
node meet in one task, which picks its cut.  The driver gets one row for each node.
A task holds sums of at most ``NUMBERS`` bins, so memory grows neither with rows
nor with nodes, and the shuffle grows with nodes and tasks, not with rows.

Sums are of whole numbers and therefore exact in any order.  Draws depend on the
seed, the tree and the place of a block in the table: they are drawn anew at every
level and never kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from plumbline.operators.random_trees import Forest, _matrix, _spread, scaled

BINS = 32
# Bins that a task holds sums of at once, two numbers each.
NUMBERS = 1 << 22
# Rows and bytes of a block at most.
ROWS, BYTES = 1 << 16, 1 << 24
# Rows of a message between a task and the JVM: half a kilobyte each.
MESSAGE = 1 << 12
# Values of a feature that are counted one by one; of a feature with more, quantiles are taken.
VALUES = 1 << 12
# Target values have at most this many bits, so that sums of a block are exact as doubles.
BITS = 34


# --- draws -------------------------------------------------------------------


def _steps() -> np.ndarray:
    """Where even 32 bits exceed the chance of 0, 1, 2, ... draws."""
    below = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
    steps = np.rint(below * 2.0**32)
    return steps[steps < 2.0**32].astype(np.uint32)


STEPS = _steps()


def drawn(seed: int, block: int, tree: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that a tree draws, and how often."""
    bits = np.random.Generator(np.random.PCG64([seed, block, tree])).integers(0, 1 << 32, n, np.uint32)
    row = np.flatnonzero(bits >= STEPS[0])
    bits, times = bits.take(row), np.ones(len(row))
    more = np.arange(len(row))
    for step in STEPS[1:]:
        more = more[bits.take(more) >= step]
        if not len(more):
            break
        times[more] += 1.0
    return row, times


# --- bins --------------------------------------------------------------------


def cut_points(rows: DataFrame, dim: int) -> list[np.ndarray]:
    """Ascending cuts of each feature, by counts of all rows: between its values, or at quantiles where it has too many."""

    def task(batches):
        seen = [(np.empty(0), np.empty(0))] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for f in range(dim):
                if seen[f] is not None:
                    value, at = np.unique(np.r_[seen[f][0], x[:, f]], return_inverse=True)
                    seen[f] = (value, np.bincount(at, np.r_[seen[f][1], np.ones(len(x))])) if len(value) <= VALUES else None
        for f in range(dim):
            value, n = seen[f] or (np.full(1, np.nan), np.ones(1))
            columns = (np.full(len(value), f), value, n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "value", "n"])

    counts = rows.mapInArrow(task, "feature bigint, value double, n bigint").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    facts = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.bool_or(F.isnan("value")).alias("more")).collect()
    many = sorted(r["feature"] for r in facts if r["more"] or r["values"] > VALUES)
    found = counts.where(~F.col("feature").isin(many)).toArrow().sort_by([("feature", "ascending"), ("value", "ascending")])
    feature, value, n = (c.to_numpy() for c in found.columns)
    out = [_between(value[feature == f], n[feature == f]) for f in range(dim)]
    for f, cuts in _quantiles(rows, dim, many).items():
        out[f] = cuts
    return out


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _doubles(key: np.ndarray) -> np.ndarray:
    bits = (key ^ np.uint64(1 << 63)).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _quantiles(rows: DataFrame, dim: int, features: list[int]) -> dict[int, np.ndarray]:
    """Cuts into ``BINS`` equal parts: each pass counts the next 12 bits of the values around the wanted ranks, 48 in all."""
    known = {f: np.zeros(BINS - 1, dtype=np.uint64) for f in features}
    rank: dict[int, np.ndarray] = {}
    for shift in (52, 40, 28, 16) if features else ():
        ends = {f: np.unique(known[f]) for f in features}

        def task(batches, ends=ends, shift=np.uint64(shift)):
            sums = {f: np.zeros(len(e) << 12, dtype=np.int64) for f, e in ends.items()}
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                for f, e in ends.items():
                    key = _ordered(x[:, f]) >> shift
                    head = key >> np.uint64(12)
                    at = np.minimum(np.searchsorted(e, head), len(e) - 1)
                    here = e[at] == head
                    cell = (at[here] << 12) + (key[here] & np.uint64(4095)).astype(np.int64)
                    sums[f] += np.bincount(cell, minlength=len(sums[f]))
            for f, n in sums.items():
                cell = np.flatnonzero(n)
                columns = (np.full(len(cell), f), cell, n[cell])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "cell", "n"])

        found = rows.mapInArrow(task, "feature bigint, cell bigint, n bigint").groupBy("feature", "cell").agg(F.sum("n").alias("n")).toArrow()
        feature, cell, n = (c.to_numpy() for c in found.columns)
        for f in features:
            sums = np.zeros(len(ends[f]) << 12, dtype=np.int64)
            sums[cell[feature == f]] = n[feature == f]
            upto = sums.reshape(len(ends[f]), -1).cumsum(axis=1)
            if f not in rank:
                rank[f] = -(-upto[0, -1] * np.arange(1, BINS) // BINS)
            for k, at in enumerate(np.searchsorted(ends[f], known[f])):
                digit = np.searchsorted(upto[at], rank[f][k])
                rank[f][k] -= upto[at, digit - 1] if digit else 0
                known[f][k] = (known[f][k] << np.uint64(12)) | np.uint64(digit)
    cuts = {f: np.unique(_doubles((known[f] << np.uint64(16)) | np.uint64(0xFFFF))) for f in features}
    return {f: c[np.isfinite(c)] for f, c in cuts.items()}


def _between(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cuts halfway between neighbouring values: all, or those that come nearest to equal numbers of rows."""
    low, high = value[:-1], value[1:]
    middle = low / 2 + high / 2
    cuts = np.where((middle >= low) & (middle < high), middle, low)
    if len(value) <= BINS:
        return cuts
    upto, kept = n.cumsum(), []
    for i in range(len(cuts)):
        wanted = upto[-1] * (len(kept) + 1) / BINS
        if abs(upto[i] - wanted) < abs(upto[i + 1] - wanted):
            kept.append(cuts[i])
    return np.array(kept[: BINS - 1])


def _blocks(rows: DataFrame, cuts: list[np.ndarray], scale: tuple[float, float]) -> DataFrame:
    """``(block, n, bins, label)``: rows of a block, the bins of a feature side by side."""
    dim = len(cuts)
    most = max(1, min(ROWS, BYTES // (dim + 8)))

    def block(part, i, x, label):
        bins = np.stack([np.searchsorted(c, x[:, f]).astype(np.uint8) for f, c in enumerate(cuts)])
        values = [[part << 32 | i], [len(x)], [bins.tobytes()], [scaled(label, *scale).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["block", "n", "bins", "label"])

    def task(batches):
        held, n, i = [], 0, 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            x, label = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            while len(x):
                held.append((x[: most - n], label[: most - n]))
                x, label, n = x[most - n :], label[most - n :], n + len(held[-1][0])
                if n == most:
                    yield block(part, i, *(np.concatenate(a) for a in zip(*held)))
                    held, n, i = [], 0, i + 1
        if n:
            yield block(part, i, *(np.concatenate(a) for a in zip(*held)))

    named = rows.select("x", "label", F.spark_partition_id().alias("part"))
    return named.mapInArrow(task, "block bigint, n bigint, bins binary, label binary")


# --- a level -----------------------------------------------------------------


class _Walk:
    """Nodes as tables that lead a row down by its bins; a leaf leads to itself."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, level: int) -> None:
        leaf = feature < 0
        self.feature, self.level = np.where(leaf, 0, feature), level
        self.cut = np.where(leaf, 255, cut).astype(np.uint8)
        self.child = np.where(leaf, np.arange(len(child)), child)

    def reached(self, flat: np.ndarray, n: int, row: np.ndarray, tree: int) -> np.ndarray:
        node = np.full(len(row), tree)
        for _ in range(self.level):
            at = self.feature.take(node)
            at *= n
            at += row
            right = flat.take(at) > self.cut.take(node)
            node = self.child.take(node)
            node += right
        return node


def _cut_level(blocks: DataFrame, walk: _Walk, tree: np.ndarray, nodes: np.ndarray, dim: int, seed: int, parts: int):
    """``(slot, feature, bin, n, total, left n, left total)`` of the open nodes of a slice that have rows; feature -1 where no cut helps."""
    slot = np.full(len(walk.cut), -1)
    slot[nodes] = np.arange(len(nodes))
    names, first = np.unique(tree, return_index=True)
    spans = list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(nodes)]))

    def add(sums, block, n, flat, label):
        for t, low, high in spans:
            row, times = drawn(seed, block, t, n)
            at = slot.take(walk.reached(flat, n, row, t))
            if at.min(initial=0) < 0:
                kept = np.flatnonzero(at >= 0)
                row, times, at = row[kept], times[kept], at[kept]
            at -= low
            at *= BINS
            values = label.take(row)
            values *= times
            for f in range(dim):
                cell = at + flat[f * n : (f + 1) * n].take(row)
                for k, weights in enumerate((times, values)):
                    sums[low:high, f, k] += np.bincount(cell, weights, (high - low) * BINS).astype(np.int64).reshape(-1, BINS)

    def task(batches):
        sums = np.zeros((len(nodes), dim, 2, BINS), dtype=np.int64)
        for batch in batches:
            for block, n, bins, label in zip(*(c.to_pylist() for c in batch.columns)):
                add(sums, block, n, np.frombuffer(bins, np.uint8), np.frombuffer(label, np.int64).astype(float))
        sums = sums.reshape(len(nodes) * dim, -1)
        seen = np.flatnonzero(sums[:, :BINS].any(axis=1))
        for i in range(0, len(seen), MESSAGE):
            part = seen[i : i + MESSAGE]
            ends = pa.py_buffer((np.arange(len(part) + 1) * (16 * BINS)).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(sums[part])])
            yield pa.RecordBatch.from_arrays([pa.array(part // dim), pa.array(part % dim), data], names=["slot", "feature", "sums"])

    def best(batches):
        held = np.zeros((len(nodes) * dim, 2 * BINS), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy() * dim + batch.column(1).to_numpy()
            sums = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(len(at), -1)
            order = np.argsort(at, kind="stable")
            at, starts = np.unique(at[order], return_index=True)
            held[at] += np.add.reduceat(sums[order], starts)
        held = held.reshape(len(nodes), dim, 2, BINS)
        seen, step = np.flatnonzero(held[:, 0, 0].any(axis=1)), max(1, MESSAGE // dim)
        for i in range(0, len(seen), step):
            yield _best_cuts(seen[i : i + step], held[seen[i : i + step]])

    messages = blocks.mapInArrow(task, "slot bigint, feature bigint, sums binary").repartition(parts, "slot")
    kinds = "slot bigint, feature bigint, bin bigint, n bigint, total bigint, n_left bigint, left bigint"
    found = messages.mapInArrow(best, kinds).toArrow().sort_by("slot")
    return [c.to_numpy() for c in found.columns]


def _best_cuts(slots: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """The cut that lowers the variance most, by node; of equals the first."""
    upto = sums.cumsum(axis=3)
    n, total = upto[:, 0, 0, -1], upto[:, 0, 1, -1]
    n_left, left = (upto[:, :, k, :-1].reshape(len(slots), -1) for k in (0, 1))
    n_right, right = n[:, None] - n_left, total[:, None] - left
    apart = (left * n_right.astype(float) - right * n_left.astype(float)) ** 2
    score = np.where((n_left > 0) & (n_right > 0), apart / np.maximum(n_left * n_right.astype(float), 1.0), 0.0)
    at, i = score.argmax(axis=1), np.arange(len(slots))
    feature, cut = np.divmod(at, BINS - 1)
    feature = np.where(score[i, at] > 0.0, feature, -1)
    columns = (slots, feature, cut, n, total, n_left[i, at], left[i, at])
    names = ["slot", "feature", "bin", "n", "total", "n_left", "left"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


# --- growing -----------------------------------------------------------------


def grow(rows: DataFrame, dim: int, trees: int = 100, depth: int = 10, seed: int = 42, numbers: int = NUMBERS) -> Forest:
    """Regression trees over ``features`` (a vector of ``dim`` numbers) and ``label``, for ``random_trees.predict``."""
    rows = rows.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    rows, spread = _spread(rows)
    blocks = None
    try:
        n, low, high = rows.agg(F.count("label"), F.min("label"), F.max("label")).first()
        if not n:
            raise ValueError("no labelled rows to grow trees on")
        middle, half = low / 2 + high / 2, high / 2 - low / 2
        scale = middle, 2.0 ** min(BITS, 60 - math.ceil(math.log2(n + 1))) / half if half else 1.0
        cuts = cut_points(rows, dim)
        blocks = _blocks(rows, cuts, scale).persist(StorageLevel.MEMORY_AND_DISK)
        return _grow(blocks, cuts, scale, trees, depth, seed, numbers)
    finally:
        if blocks is not None:
            blocks.unpersist()
        if spread:
            rows.unpersist()


def _grow(blocks: DataFrame, cuts: list[np.ndarray], scale: tuple[float, float], trees: int, depth: int, seed: int, numbers: int) -> Forest:
    dim, parts = len(cuts), min(trees, blocks.sparkSession.sparkContext.defaultParallelism)
    feature, cut, child = np.full(trees, -1), np.zeros(trees, dtype=np.int64), np.zeros(trees, dtype=np.int64)
    stats, tree = np.zeros((trees, 2), dtype=np.int64), np.arange(trees)
    open_nodes, width = np.arange(trees), max(1, numbers // (dim * BINS))
    # a tree of depth 0 still needs its sums
    for level in range(max(1, depth)):
        walk, made = _Walk(feature, cut, child, level), []
        for i in range(0, len(open_nodes), width):
            nodes = open_nodes[i : i + width]
            slot, *found = _cut_level(blocks, walk, tree[nodes], nodes, dim, seed, parts)
            made.append((nodes[slot], *found))
        nodes, by, at, n, total, n_left, left = (np.concatenate(a) for a in zip(*made))
        if not level:
            stats[nodes] = np.stack([n, total], axis=1)
        splits = (by >= 0) if depth else np.zeros(len(by), dtype=bool)
        nodes, by, at, n, total, n_left, left = (a[splits] for a in (nodes, by, at, n, total, n_left, left))
        if not len(nodes):
            break
        first, count = len(stats), len(nodes)
        feature[nodes], cut[nodes], child[nodes] = by, at, first + 2 * np.arange(count)
        sides = np.stack([n_left, left, n - n_left, total - left], axis=1).reshape(2 * count, 2)
        feature, cut, child = (np.r_[a, np.full(2 * count, fill)] for a, fill in ((feature, -1), (cut, 0), (child, 0)))
        stats, tree = np.r_[stats, sides], np.r_[tree, tree[nodes].repeat(2)]
        open_nodes = np.flatnonzero((np.arange(len(stats)) >= first) & (stats[:, 0] > 1))
        if not len(open_nodes):
            break
    middle, factor = scale
    value = stats[:, 1] / np.maximum(stats[:, 0], 1) / factor + middle
    places = np.zeros(len(feature))
    inner = np.flatnonzero(feature >= 0)
    places[inner] = [cuts[f][c] for f, c in zip(feature[inner].tolist(), cut[inner].tolist())]
    return Forest(trees, feature, places, child, value[:, None])
