"""Whitening against numpy and exact arithmetic, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, id long, vector string"


def frame(spark, pairs, kind="float"):
    rows = [(i, v, 1, "x", 2, "y") for i, v in pairs]
    return spark.createDataFrame(rows, SCHEMA.replace("<float>", f"<{kind}>")).repartition(3)


def whole(v):
    return [math.floor(1024 * float(c)) + 100_000 for c in v]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (60, 12)) @ rng.normal(0, 0.3, (12, 12))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]


def test_components_match_numpy(spark, vectors):
    odd = [(100, None), (101, [None] + [0.0] * 11), (102, [float("nan")] * 12), (103, [float("inf")] * 12), (104, []), (105, [1.0, 2.0])]
    good = [*vectors, (3, vectors[3][1]), (None, vectors[7][1])]
    out = whitening.whitened_components(frame(spark, good + odd)).collect()
    x = np.array([whole(v) for _, v in good])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    w = centred @ axes[:, :8] / np.sqrt(values[:8])
    assert len(out) == 8 * n and {r.n for r in out} == {n} and {r.component for r in out} == set(range(1, 9))
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
    for k in range(8):
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in out if r.component == k + 1)
        want = sorted((-1 if i is None else i, w[j, k]) for j, (i, _) in enumerate(good))
        sign = math.copysign(1, mine[5][1] * want[5][1])
        np.testing.assert_allclose([a for _, a in mine], [sign * b for _, b in want], rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose({r.explained for r in out if r.component == k + 1}.pop(), values[k] / values.sum(), rtol=1e-9)
    want = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for (i, _), row in zip(good, x, strict=True)}
    assert {r.vec_id: r.deviation for r in out} == want


def test_sums_are_exact_at_any_size():
    for scale in (3, 1 << 20, 1 << 30, 1 << 40):
        y = np.random.default_rng(scale).integers(-scale, scale, (50, 5))
        y[0] = scale
        want = [sum(int(v) ** 2 for v in y[:, a]) for a in range(5)]
        want += [sum((int(p) + int(q)) ** 2 for p, q in zip(y[:, a], y[:, b], strict=True)) for a in range(5) for b in range(a + 1, 5)]
        assert whitening.exact_sums(y) == want


def test_covariance_has_no_rounding_but_the_last():
    y = np.random.default_rng(1).integers(-(1 << 35), 1 << 35, (40, 4))
    v = whitening.covariance(40, [int(s) for s in y.sum(axis=0)], whitening.exact_sums(y))
    for a in range(4):
        for b in range(4):
            mean = [Fraction(int(y[:, k].sum()), 40) for k in (a, b)]
            exact = sum((int(p) - mean[0]) * (int(q) - mean[1]) for p, q in zip(y[:, a], y[:, b], strict=True)) / 40
            assert v[a, b] == float(exact)


def test_far_values_and_flat_directions(spark):
    rows = [(i, [1e6 + i, 5.0, float(i % 3), 2.0 * (1e6 + i)]) for i in range(30)]
    out = whitening.whitened_components(frame(spark, rows, "double")).collect()
    by = {k: [r for r in out if r.component == k] for k in range(1, 5)}
    assert all(r.whitened is not None for r in by[1] + by[2])
    assert all(r.whitened is None for r in by[3] + by[4]) and out[0].identity_error < 1e-4
    x = [whole(v) for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: r.deviation for r in out} == {i: sum((30 * c - s) ** 2 for c, s in zip(x[i], sums, strict=True)) for i in range(30)}


def test_a_deviation_beyond_a_long_is_null_in_the_rows_and_exact_in_the_operator(spark):
    rows = frame(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0])], "double")
    assert [r.deviation for r in whitening.whitened_components(rows).collect()] == [None] * 4
    want = (2 * 1024 * 10**9) ** 2 + 1024**2
    assert [int(r.deviation) for r in whitening.whiten(rows).collect()] == [want, want]


def test_equal_vectors_and_one_vector(spark):
    for rows in ([(1, [0.5, 0.25])], [(k, [0.5, 0.25]) for k in range(4)]):
        out = whitening.whitened_components(frame(spark, rows)).collect()
        assert len(out) == 2 * len(rows)
        assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(0, None, None, 0.0)}


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None), (2, [])]):
        assert whitening.whitened_components(frame(spark, rows)).collect() == []
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_rows_do_not_depend_on_partitions(spark, vectors):
    one = whitening.whitened_components(frame(spark, vectors).coalesce(1)).collect()
    many = whitening.whitened_components(frame(spark, vectors).repartition(13)).collect()
    key = lambda r: (r.vec_id, r.component)
    close = lambda a, b: a == pytest.approx(b, abs=1e-12)
    assert all(a[:4] == b[:4] and close(a[4], b[4]) for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True))
