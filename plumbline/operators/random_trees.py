"""Extremely randomised trees, grown level by level from statistics of all rows.

Every tree sees every row.  A level takes two aggregates for all trees at once:
the range of each feature in each open node, and the target on the right of the
few random cuts drawn from those ranges.  A task keeps numbers for at most
``NUMBERS`` cells, emits one row for each cell it saw, and one grouped sum brings
them together, so the shuffle grows with nodes and tasks and not with rows.

Sums are of whole numbers, and draws depend on the seed and the node's place in
its tree alone: the partitions of the rows never change a tree.  The nodes are
the model; they live on the driver and travel to the tasks, as the trees of
Spark's own forests do.  Without a depth limit their number can reach twice the
rows for each tree.

Missing features count as positive infinity.  Rows without a label are left out;
no rows at all are an error.  Nodes whose rows are equal in all features, or
in the target, are leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# Cells of statistics that a task and the driver hold at once.
NUMBERS = 1 << 20
# Rows a task follows down a tree at once: enough that a node has several of them.
ROWS = 1 << 16
# Rows of a message between a task and the JVM.
MESSAGE = 1 << 16


@dataclass
class Forest:
    """Nodes of all trees; tree ``t`` starts at node ``t``, the right child follows the left."""

    trees: int
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        n, wide = self.value.shape
        shares = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(self.value.ravel()))
        columns = (np.arange(n), self.feature, self.cut, self.child)
        names = ("node", "feature", "cut", "child")
        return spark.createDataFrame(pa.table({**dict(zip(names, map(pa.array, columns))), "value": shares}))

    @staticmethod
    def of(table: DataFrame, trees: int) -> Forest:
        found = table.toArrow().sort_by("node").combine_chunks()
        arrays = [found[c].to_numpy() for c in ("feature", "cut", "child")]
        value = found["value"].combine_chunks().flatten().to_numpy()
        return Forest(trees, *arrays, value.reshape(found.num_rows, -1))


# --- draws -------------------------------------------------------------------


def draw(node: np.ndarray, salt: int) -> np.ndarray:
    """64 even bits for each node name (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = node + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(node: np.ndarray, salt: int) -> np.ndarray:
    return (draw(node, salt) >> np.uint64(11)) / float(1 << 53)


def root_names(trees: int, seed: int) -> np.ndarray:
    return draw(np.arange(trees, dtype=np.uint64), seed)


def random_cuts(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """``(feature, cut)`` by node and attempt; -1 where a node has fewer features that vary.

    The features are a random choice of those that vary in the node, the cut lies
    evenly between the least and the greatest value, and both sides keep a row.
    """
    dim = lo.shape[1]
    order = np.stack([uniform(names, 2 * f + 3) for f in range(dim)], axis=1)
    order[~(hi > lo)] = 2.0
    chosen = np.argsort(order, axis=1, kind="stable")[:, :tried]
    at = np.arange(len(names))[:, None]
    share = np.stack([uniform(names, 2 * f + 4) for f in range(dim)], axis=1)[at, chosen]
    low, high = lo[at, chosen], np.minimum(hi[at, chosen], np.finfo(float).max)
    cut = low * (1.0 - share) + high * share
    cut = np.where((cut >= low) & (cut < high), cut, low)
    return np.where(order[at, chosen] < 2.0, chosen, -1), cut


def gain(right: np.ndarray, total: np.ndarray, classify: bool) -> np.ndarray:
    """How well cuts divide the target: by Gini impurity or by variance, higher is better."""
    left = total - right
    if classify:
        parts = [(s.astype(float) ** 2).sum(-1) / np.maximum(s.sum(-1), 1) for s in (left, right)]
    else:
        parts = [s[..., 1].astype(float) ** 2 / np.maximum(s[..., 0], 1) for s in (left, right)]
    return parts[0] + parts[1]


# --- rows through trees ------------------------------------------------------


def walk(flat: np.ndarray, n: int, root: int, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node that each of ``n`` rows, laid out feature by feature, reaches from ``root``."""
    at, row, node = np.empty(n, np.int64), np.arange(n), np.full(n, root)
    while True:
        f = feature.take(node)
        inner = f >= 0
        if not inner.all():
            at[row[~inner]] = node[~inner]
            row, node, f = row[inner], node[inner], f[inner]
            if not len(row):
                return at
        f *= n
        f += row
        right = flat.take(f) > cut.take(node)
        node = child.take(node)
        node += right


def route(x: np.ndarray, trees: int, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node each row has reached in each tree."""
    flat = x.T.ravel()
    return np.stack([walk(flat, len(x), t, feature, cut, child) for t in range(trees)], axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return np.where(np.isnan(x), np.inf, x)


def _messages(key: np.ndarray, **columns: np.ndarray):
    for i in range(0, len(key), MESSAGE):
        names = ["key", *columns]
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + MESSAGE]) for a in (key, *columns.values())], names=names)


class _Level:
    """What tasks need to find the open nodes of a slice in their rows."""

    def __init__(self, forest: Forest, dim: int, nodes: np.ndarray) -> None:
        self.tables = (forest.feature, forest.cut, forest.child)
        self.dim, self.open = dim, len(nodes)
        self.slot = np.full(len(forest.cut), -1)
        self.slot[nodes] = np.arange(len(nodes))
        inner = np.flatnonzero(forest.feature >= 0)
        root = np.arange(len(forest.cut))
        root[forest.child[inner]] = root[forest.child[inner] + 1] = inner
        while (root >= forest.trees).any():
            root = root[root]
        self.trees = np.unique(root[nodes]).tolist()

    def chunks(self, batches):
        """Rows and labels of several batches together."""
        held, n = [], 0
        for batch in batches:
            held.append((_matrix(batch.column(0), self.dim), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= ROWS:
                yield tuple(np.concatenate(a) for a in zip(*held))
                held, n = [], 0
        if n:
            yield tuple(np.concatenate(a) for a in zip(*held))

    def runs(self, batches):
        """``(flat, label, row, slots, starts)``: a tree's rows in open nodes, sorted by slot, and where each begins."""
        for x, label in self.chunks(batches):
            flat, n = x.T.ravel(), len(x)
            for t in self.trees:
                slot = self.slot.take(walk(flat, n, t, *self.tables))
                row = np.flatnonzero(slot >= 0)
                if not len(row):
                    continue
                slot = slot[row]
                # a tree's slots lie together; short keys are sorted by radix
                near = slot - slot.min()
                order = np.argsort(near.astype(np.int16) if near.max() < 1 << 15 else near, kind="stable")
                row, slot = row[order], slot[order]
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                yield flat, label, row, slot[starts], starts


def _ranges(rows: DataFrame, level: _Level) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each feature, then of the label, in each open node."""
    wide = level.dim + 1

    def task(batches):
        lo, hi = np.full((level.open, wide), np.inf), np.full((level.open, wide), -np.inf)
        for flat, label, row, slots, starts in level.runs(batches):
            n = len(label)
            for f in range(wide):
                v = (flat[f * n : (f + 1) * n] if f < level.dim else label)[row]
                lo[slots, f] = np.minimum(lo[slots, f], np.minimum.reduceat(v, starts))
                hi[slots, f] = np.maximum(hi[slots, f], np.maximum.reduceat(v, starts))
        seen = np.flatnonzero(np.isfinite(lo[:, -1]).repeat(wide))
        yield from _messages(seen, lo=lo.ravel()[seen], hi=hi.ravel()[seen])

    cells = rows.mapInArrow(task, "key bigint, lo double, hi double")
    found = cells.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    out = np.zeros((2, level.open * wide))
    out[:, found["key"].to_numpy()] = found["lo"].to_numpy(), found["hi"].to_numpy()
    return out[0].reshape(-1, wide), out[1].reshape(-1, wide)


def _right_sides(rows: DataFrame, level: _Level, feature: np.ndarray, cut: np.ndarray, classes: int, scale) -> np.ndarray:
    """The target's sums right of each cut: counts by class, or rows and scaled values."""
    tried, cells = feature.shape[1], classes or 2

    def task(batches):
        sums = np.zeros((level.open, tried, cells), dtype=np.int64)
        for flat, label, row, slots, starts in level.runs(batches):
            sizes = np.diff(np.r_[starts, len(row)])
            target = label[row].astype(np.int64) if classes else scaled(label, *scale)[row]
            for k in range(tried):
                f = np.repeat(feature[slots, k], sizes)
                right = (f >= 0) & (flat[f * len(label) + row] > np.repeat(cut[slots, k], sizes))
                if classes:
                    run = np.repeat(np.arange(len(slots)) * classes, sizes)
                    part = np.bincount(run[right] + target[right], minlength=len(slots) * classes)
                    sums[slots, k] += part.reshape(-1, classes)
                else:
                    sums[slots, k, 0] += np.add.reduceat(right.astype(np.int64), starts)
                    sums[slots, k, 1] += np.add.reduceat(target * right, starts)
        sums = sums.ravel()
        seen = np.flatnonzero(sums)
        yield from _messages(seen, n=sums[seen])

    found = rows.mapInArrow(task, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(level.open * tried * cells, dtype=np.int64)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(level.open, tried, cells)


def scaled(label: np.ndarray, middle: float, factor: float) -> np.ndarray:
    """A target as whole numbers, whose sums are exact."""
    return np.rint((label - middle) * factor).astype(np.int64)


def _totals(rows: DataFrame, classes: int) -> tuple[np.ndarray, tuple[float, float]]:
    if classes:
        counts = np.zeros(classes, dtype=np.int64)
        for label, n in rows.groupBy("label").count().collect():
            counts[int(label)] = n
        return counts, (0.0, 1.0)
    n, lo, hi = rows.agg(F.count("label"), F.min("label"), F.max("label")).first()
    if not n:
        return np.zeros(2, dtype=np.int64), (0.0, 1.0)
    middle, half = lo / 2 + hi / 2, hi / 2 - lo / 2
    factor = 2.0 ** min(40, 62 - math.ceil(math.log2(n + 1))) / half if half else 1.0
    total = rows.agg(F.sum(F.rint((F.col("label") - F.lit(middle)) * F.lit(factor)).cast("bigint"))).first()[0]
    return np.array([n, total], dtype=np.int64), (middle, factor)


# --- growing -----------------------------------------------------------------


def grow(
    rows: DataFrame,
    dim: int,
    classes: int = 0,
    trees: int = 100,
    depth: int | None = None,
    tried: int | None = None,
    seed: int = 42,
    numbers: int = NUMBERS,
) -> Forest:
    """Trees over ``features`` (a vector of ``dim`` numbers) and ``label``.

    ``classes`` labels from 0, or 0 for a regression.  ``tried`` features are
    tried at a node: the square root of their number, or all for a regression.
    ``depth`` None grows until nodes are pure.
    """
    rows = rows.where("label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    rows, spread = _spread(rows)
    try:
        return _grow(rows, dim, classes, trees, depth, tried, seed, numbers)
    finally:
        if spread:
            rows.unpersist()


def _spread(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The work is rows times trees, so even a table in a single file is dealt to all cores, once."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows, False
    return rows.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK), True


def _grow(rows, dim, classes, trees, depth, tried, seed, numbers) -> Forest:
    total, scale = _totals(rows, classes)
    if not total.any():
        raise ValueError("no labelled rows to grow trees on")
    tried = min(dim, tried or (max(1, math.isqrt(dim)) if classes else dim))
    stats, names = np.tile(total, (trees, 1)), root_names(trees, seed)
    forest = Forest(trees, np.full(trees, -1), np.zeros(trees), np.zeros(trees, dtype=np.int64), stats)
    width, level = max(1, numbers // max(dim + 1, tried * len(total))), 0
    open_nodes = _worth_splitting(stats, np.arange(trees), classes)
    while len(open_nodes) and (depth is None or level < depth):
        # every slice reads the trees as they were when the level began
        before, made = forest, []
        for i in range(0, len(open_nodes), width):
            nodes = open_nodes[i : i + width]
            lo, hi = _ranges(rows, _Level(before, dim, nodes))
            nodes, lo, hi = (a[hi[:, -1] > lo[:, -1]] for a in (nodes, lo, hi))
            feature, cut = random_cuts(names[nodes], lo[:, :dim], hi[:, :dim], tried)
            splits = feature[:, 0] >= 0
            nodes, feature, cut = nodes[splits], feature[splits], cut[splits]
            if len(nodes):
                right = _right_sides(rows, _Level(before, dim, nodes), feature, cut, classes, scale)
                score = np.where(feature >= 0, gain(right, stats[nodes][:, None, :], bool(classes)), -np.inf)
                best = score.argmax(axis=1), np.arange(len(nodes))
                made.append((nodes, feature[best[1], best[0]], cut[best[1], best[0]], right[best[1], best[0]]))
        if not made:
            break
        nodes, feature, cut, right = (np.concatenate(a) for a in zip(*made))
        first, count = len(stats), len(nodes)
        forest = Forest(trees, *(np.r_[a, np.full(2 * count, fill)] for a, fill in ((before.feature, -1), (before.cut, 0.0), (before.child, 0))), stats)
        forest.feature[nodes], forest.cut[nodes], forest.child[nodes] = feature, cut, first + 2 * np.arange(count)
        stats = np.r_[stats, np.stack([stats[nodes] - right, right], axis=1).reshape(2 * count, -1)]
        names = np.r_[names, np.stack([draw(names[nodes], 1), draw(names[nodes], 2)], axis=1).ravel()]
        open_nodes = _worth_splitting(stats, np.arange(first, len(stats)), classes)
        level += 1
    if classes:
        forest.value = stats / stats.sum(axis=1, keepdims=True)
    else:
        forest.value = (stats[:, 1] / stats[:, 0] / scale[1] + scale[0])[:, None]
    return forest


def _worth_splitting(stats: np.ndarray, nodes: np.ndarray, classes: int) -> np.ndarray:
    one = stats[nodes]
    return nodes[(one > 0).sum(axis=1) > 1] if classes else nodes[one[:, 0] > 1]


def predict(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``prediction``: the class of the greatest mean share (the first of equals), or the mean of the trees."""
    trees, feature, cut, child, value = forest.trees, forest.feature, forest.cut, forest.child, forest.value

    @F.pandas_udf("double")
    def vote(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column))
        for i in range(0, len(out), ROWS):
            x = np.stack(column.iloc[i : i + ROWS].to_list())
            flat = np.where(np.isnan(x), np.inf, x).T.ravel()
            total = np.zeros((len(x), value.shape[1]))
            for t in range(trees):
                total += value[walk(flat, len(x), t, feature, cut, child)]
            out[i : i + ROWS] = total.argmax(axis=1) if value.shape[1] > 1 else total[:, 0] / trees
        return pd.Series(out)

    return df.withColumn("prediction", vote(vector_to_array("features")))
