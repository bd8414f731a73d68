"""Expressions, counts, quantiles and moments on small frames."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.config import name_matches
from plumbline.functions import counts, exprs
from plumbline.functions.moments import pair_moments
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.schema import nan_to_null


def text(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def apply(spark, f, values):
    return [r[0] for r in text(spark, values).select("i", f(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def test_strip_symbols_keeps_signs_and_letters_of_any_language(spark):
    given = ["  -5 ", "$-5", "--x--", "???", "élan!", None, "(a-b)", ".5", "-", "**+.7"]
    assert apply(spark, exprs.strip_symbols, given) == ["-5", "-5", "x", "", "élan", None, "a-b", ".5", "", "+.7"]


def test_strip_symbols_ascii_mode(spark):
    assert apply(spark, lambda c: exprs.strip_symbols(c, True), ["-5", "élan", "a."]) == ["5", "lan", "a"]


def test_to_number_takes_plain_decimals_only(spark):
    given = ["1", " 1.5 ", "-.5", "1e3", "1d", "1.5f", "inf", "NaN", "0x1", "", None, "1,000"]
    assert apply(spark, exprs.to_number, given) == [1.0, 1.5, -0.5, 1000.0] + [None] * 8


def test_currency_scales_suffix_or_not(spark):
    given = ["$1,200", "₹5K", "€2.5M", "3 k", "x"]
    assert apply(spark, exprs.currency_to_number, given) == [1200.0, 5000.0, 2.5e6, 3000.0, None]
    assert apply(spark, lambda c: exprs.currency_to_number(c, False), ["$5K", "2M"]) == [5.0, 2.0]


def test_title_case_restarts_after_any_non_letter(spark):
    assert apply(spark, exprs.title_case, ["o'neil", "new-york CITY", "a1b", None, "ab cd"]) == [
        "O'Neil", "New-York City", "A1B", None, "Ab Cd",
    ]


def test_to_time_formats_and_impossible_dates(spark):
    given = ["2024-02-29", "2023-02-29", "02/03/2024", "3 Mar 2024", "2024", "2024-01-01 10:00:00", "20240101", None]
    got = [None if v is None else v.isoformat() for v in apply(spark, exprs.to_time, given)]
    assert got == [
        "2024-02-29T00:00:00", None, "2024-02-03T00:00:00", "2024-03-03T00:00:00", None, "2024-01-01T10:00:00", None, None,
    ]


def test_nan_is_missing_and_zero_has_one_sign(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (-0.0,), (0.0,), (None,)], "x double"))
    assert df.where("x is null").count() == 2
    assert [str(r[0]) for r in df.where("x is not null").collect()] == ["0.0", "0.0"]


def test_names_match_whole_words(spark):
    assert name_matches("visits_count", ("count",)) and name_matches("orderCount", ("count",))
    assert not name_matches("l_discount", ("count",))
    assert name_matches("l_discount", ("count",), substring=True)


def test_mode_ties_go_to_the_smallest_value_in_its_own_order(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b"), (None, None)], "n int, s string")
    got = {r["column"]: r for r in counts.distinct_and_mode(df, ["n", "s"]).collect()}
    assert (got["n"]["top_value"], got["n"]["distinct"], got["n"]["distinct_all"]) == ("9", 2, 3)
    assert got["s"]["top_value"] == "a"
    assert counts.modes(df, ["n", "s"]) == {"n": 9, "s": "a"}


def test_duplicate_rows_are_exact(spark):
    rows = [(1, None), (1, None), (None, 1), (2, "x"), (2, "x"), (2, "x")]
    df = spark.createDataFrame([(a, None if b is None else str(b)) for a, b in rows], "a int, b string")
    assert counts.duplicate_rows(df) == 3


def test_with_distinct_is_exact_at_the_limit(spark):
    df = spark.createDataFrame([(i % 4, i % 5, i) for i in range(1000)], "a int, b int, c int")
    assert counts.with_distinct(df, ["a", "b", "c"], 5) == ["b", "c"]


def reference_quantiles(values, probs):
    ordered, out = sorted(values), []
    for p in probs:
        pos = (len(ordered) - 1) * p
        lo, hi = ordered[math.floor(pos)], ordered[math.ceil(pos)]
        out.append(lo if lo == hi else (math.ceil(pos) - pos) * lo + (pos - math.floor(pos)) * hi)
    return out


SHAPES = {
    "uniform": lambda r: [r.uniform(-5, 5) for _ in range(3000)],
    "ties": lambda r: [r.choice([1.0, 2.0, 2.0, 2.0, 3.0]) for _ in range(3000)],
    "one_value": lambda r: [7.0] * 3000,
    "far_outlier": lambda r: [r.random() for _ in range(2999)] + [1e300],
    "spread_magnitudes": lambda r: [10.0 ** r.uniform(-200, 200) for _ in range(3000)],
    "two_heavy_ends": lambda r: [0.0] * 1490 + [r.random() for _ in range(20)] + [1.0] * 1490,
    "infinite": lambda r: [r.random() for _ in range(2000)] + [float("inf")] * 500 + [float("-inf")] * 500,
}


@pytest.mark.parametrize("finish", [0, 40, 10_000])
def test_selected_quantiles_are_exact(spark, finish):
    """The selection path with tiny limits, against sorting; ``finish=0`` never lists values."""
    r = random.Random(3)
    data = {k: f(r) for k, f in SHAPES.items()}
    n = 3000
    rows = [tuple(data[k][i] if i < len(data[k]) else None for k in data) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in data))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    columns = list(data) if finish else ["ties", "one_value"]
    got = exact_quantiles(df, columns, probs, in_memory=10, finish=finish, accuracy=100)
    for k in columns:
        for a, b in zip(got[k], reference_quantiles(data[k], probs)):
            assert a == b or math.isclose(a, b, rel_tol=1e-12), (k, got[k])


@pytest.mark.parametrize("limit", [64, 8, 1])
def test_long_text_is_counted_like_short_text(spark, monkeypatch, limit):
    r = random.Random(limit)
    long_ = ["the same beginning of every text " * 4 + str(k) for k in range(30)] + ["é" * 90, "z" * 70, "short", ""]
    rows = [(r.choice(long_[:4]) if r.random() < 0.3 else r.choice(long_), r.choice([None, "a" * 100, "b" * 100]), None, f"unique {k} " * 12) for k in range(400)]
    df = spark.createDataFrame(rows, "`a b` string, tied string, none string, own string")
    want = []
    for i, c in enumerate(df.columns):
        seen = [x[i] for x in rows if x[i] is not None]
        top = min(((-seen.count(v), v) for v in set(seen)), default=(0, None))
        want.append((c, len(set(seen)), len(set(x[i] for x in rows)), top[1], -top[0]))
    monkeypatch.setattr(counts, "HASHED_FROM", limit)
    assert sorted(map(tuple, counts.distinct_and_mode(df, df.columns).collect())) == sorted(want)
    assert counts.modes(df, df.columns) == {w[0]: w[3] for w in want}
    assert counts.long_text(df, df.columns) == ["a b", "tied", "own"]
    assert counts.distinct_and_mode(df.where("false"), df.columns).count() == 0


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}


def test_pair_moments_match_builtin_functions_with_missing_values(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        x = r.gauss(1e6, 3)
        rows.append((x, None if i % 7 == 0 else 2 * x + r.gauss(0, 1), None if i % 5 == 0 else r.random(), 4.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "k"), ("k", "b")]
    got = pair_moments(df, pairs)
    for x, y in pairs:
        # built-in corr raises on a constant column, so it is only asked elsewhere
        flat = "k" in (x, y)
        r = F.lit(None) if flat else F.corr(x, y)
        e = df.agg(F.regr_count(y, x), F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_r2(y, x), r).first()
        m = got[x, y]
        assert m.n == e[0]
        for mine, theirs in ((m.slope, e[1]), (m.intercept, e[2]), (m.r2, e[3])):
            assert (mine is None) == (theirs is None)
            assert mine is None or math.isclose(mine, theirs, rel_tol=1e-6, abs_tol=1e-9)
        assert m.r is None if flat else math.isclose(m.r, e[4], rel_tol=1e-9)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8)), min_size=1, max_size=30))
def test_strip_symbols_is_idempotent(spark, values):
    once = apply(spark, exprs.strip_symbols, values)
    assert apply(spark, exprs.strip_symbols, once) == once
