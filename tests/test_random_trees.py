"""Random-cut trees against a plain recursive grower, and what they do with odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from plumbline.operators import random_trees as rt

SCHEMA = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])


def frame(spark, x, y, parts=3):
    rows = [(Vectors.dense(v), None if t is None else float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).cache()


def data(classes, n=150, dim=4):
    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(n, dim)), 2)
    x[:, 2] = r.integers(0, 3, n)
    signal = x[:, 0] + (x[:, 2] == 1) + r.normal(size=n) * 0.2
    return x, np.digitize(signal, [-0.5, 0.8]) if classes else np.round(signal, 3)


def plain_tree(x, y, name, classes, tried, depth):
    """One tree as nested tuples, row by row and node by node; leaves are lists of labels."""
    lo, hi = x.min(axis=0), x.max(axis=0)
    if len(set(y)) == 1 or depth == 0 or not (hi > lo).any():
        return list(y)
    one = np.array([name], dtype=np.uint64)
    options = []
    for f in range(x.shape[1]):
        if hi[f] > lo[f]:
            share = rt.uniform(one, 2 * f + 4)[0]
            cut = lo[f] * (1 - share) + hi[f] * share
            options.append((rt.uniform(one, 2 * f + 3)[0], f, cut if lo[f] <= cut < hi[f] else lo[f]))
    best = None
    for _, f, cut in sorted(options)[:tried]:
        right = x[:, f] > cut
        loss = 0.0
        for side in (y[right], y[~right]):
            loss += len(side) * (1 - sum((side == c).mean() ** 2 for c in range(classes)) if classes else side.var())
        if best is None or loss < best[0] - 1e-9:
            best = loss, f, cut, right
    _, f, cut, right = best
    kids = [plain_tree(x[m], y[m], rt.draw(one, s)[0], classes, tried, depth - 1) for m, s in ((~right, 1), (right, 2))]
    return f, cut, *kids


def plain_value(tree, v, classes):
    while isinstance(tree, tuple):
        tree = tree[3] if v[tree[0]] > tree[1] else tree[2]
    return np.array([np.mean(np.array(tree) == c) for c in range(classes)] if classes else [np.mean(tree)])


@pytest.mark.parametrize("classes,tried", [(3, 2), (0, 4)])
@pytest.mark.parametrize("depth", [None, 3])
def test_equals_plain_trees(spark, classes, tried, depth):
    x, y = data(classes)
    forest = rt.grow(frame(spark, x, y), 4, classes, trees=6, depth=depth, tried=tried, seed=5)
    trees = [plain_tree(x, y, n, classes, tried, 99 if depth is None else depth) for n in rt.root_names(6, 5)]
    reached = rt.route(x, 6, forest.feature, forest.cut, forest.child)
    for t, tree in enumerate(trees):
        want = np.stack([plain_value(tree, v, classes) for v in x])
        assert np.allclose(forest.value[reached[:, t]], want, atol=1e-8)
    mean = np.mean([[plain_value(tree, v, classes) for v in x] for tree in trees], axis=0)
    got = {tuple(r["features"]): r["prediction"] for r in rt.predict(frame(spark, x, y), forest).collect()}
    for v, m in zip(x, mean):
        assert got[tuple(v)] == pytest.approx(m.argmax() if classes else m[0], abs=1e-8)


@pytest.mark.parametrize("classes", [3, 0])
def test_neither_partitions_nor_slices_change_trees(spark, classes):
    x, y = data(classes)
    a = rt.grow(frame(spark, x, y, 1), 4, classes, trees=5, depth=4, seed=1)
    b = rt.grow(frame(spark, x[::-1], y[::-1], 7), 4, classes, trees=5, depth=4, seed=1, numbers=100)
    reached = [rt.route(x, 5, f.feature, f.cut, f.child) for f in (a, b)]
    assert np.array_equal(a.value[reached[0]], b.value[reached[1]])
    assert len(a.cut) == len(b.cut)


def test_depth_beyond_thirty(spark):
    """Growing gaps make random cuts peel a row or two at a time, so pure nodes lie deep."""
    x, y = np.array([[4.0**i] for i in range(48)]), np.arange(48) % 2
    forest = rt.grow(frame(spark, x, y, 1), 1, 2, trees=2)
    reached = rt.route(x, 2, forest.feature, forest.cut, forest.child)
    assert all(np.array_equal(forest.value[reached[:, t]].argmax(axis=1), y) for t in range(2))
    depth, level = 0, np.arange(2)
    while len(level := level[forest.feature[level] >= 0]):
        depth, level = depth + 1, np.r_[forest.child[level], forest.child[level] + 1]
    assert depth > 30


def test_equal_rows_missing_features_and_labels(spark):
    x = [[1.0, float("nan")], [1.0, float("nan")], [1.0, 2.0], [1.0, 2.0]]
    forest = rt.grow(frame(spark, x, [1, 1, 0, None]), 2, 2, trees=4)
    got = [(r["features"][1], r["prediction"]) for r in rt.predict(frame(spark, x, [None] * 4), forest).collect()]
    assert all(p == (0.0 if v == 2.0 else 1.0) for v, p in got)
    same = rt.grow(frame(spark, [[1.0]] * 4, [5, 5, 9, 9]), 1, trees=2)
    assert same.value.ravel().tolist() == pytest.approx([7.0, 7.0])
    constant = rt.grow(frame(spark, [[1.0], [2.0]], [3, 3]), 1, trees=2)
    assert constant.value.ravel().tolist() == [3.0, 3.0]
    with pytest.raises(ValueError):
        rt.grow(frame(spark, [[1.0]], [None]), 1, 2)
    assert rt.predict(frame(spark, x, [0] * 4).limit(0), forest).count() == 0


def test_large_values_split_between_them(spark):
    x = [[-1e308], [1e308], [1e308]]
    forest = rt.grow(frame(spark, x, [0, 1, 1]), 1, 2, trees=3)
    got = [(r["features"][0] > 0, r["prediction"]) for r in rt.predict(frame(spark, x, [0] * 3), forest).collect()]
    assert all(p == float(up) for up, p in got)


def test_a_task_follows_many_rows_down_a_tree_at_once(spark, monkeypatch):
    """Batches are put together, so that a node's rows are a run and not one by one."""
    x, y = data(0, n=3000)
    level = rt._Level(rt.Forest(4, np.full(4, -1), np.zeros(4), np.zeros(4, dtype=np.int64), None), 4, np.array([1, 3]))
    kind = pa.list_(pa.float64())
    parts = [(x[i : i + 100], y[i : i + 100]) for i in range(0, 3000, 100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(a.tolist(), kind), pa.array(b)], ["x", "label"]) for a, b in parts]
    runs = list(level.runs(iter(batches)))
    assert [len(row) for _, _, row, _, _ in runs] == [3000, 3000] and [slots.tolist() for *_, slots, _ in runs] == [[0], [1]]
    monkeypatch.setattr(rt, "ROWS", 1000)
    assert [len(row) for _, _, row, _, _ in level.runs(iter(batches))] == [1000] * 6
