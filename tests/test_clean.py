"""Cleaning steps and runs on small frames."""


import pytest
from pyspark.sql import functions as F

from plumbline.config import BasicCleanOptions, CleanOptions
from plumbline.operators import clean
from plumbline.operators.clean_runs import clean_basic, clean_table
from plumbline.plans.fixtures import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_standardize_names_resolves_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a b", "a-b", " A__b ", "--"])
    assert clean.standardize_names(df).columns == ["a_b", "a_b_2", "A_b_3", "column"]


def test_null_stays_null_under_token_matching(spark):
    df = spark.createDataFrame([(None,), (" NA ",), ("nan",), ("x",), ("",)], "s string")
    assert clean.normalize_missing(df).where("s is null").count() == 4


def test_numeric_strings_share_counts_all_rows(spark):
    df = spark.createDataFrame([("1", "1")] * 8 + [("x", None), ("2", None), ("3", None)], "a string, b string")
    out = clean.numeric_strings(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string"}
    assert out.where("a is null").count() == 1


def test_infinite_and_fractional_values(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("-inf"), 2.5), (1.5, -3.0), (None, 2 + 1e-10)], "x double, item_count double")
    assert rows(clean.replace_infinite(df).select("x")) == [(1.5,), (None,), (None,), (None,)]
    assert clean.clean_integers(df, ("count",)).where("item_count is null").count() == 1


def test_restore_integers_by_value_and_by_name(spark):
    df = spark.createDataFrame([(1.0, 2.0004, 1.5, 1e300), (None, 3.0, 2.0, 1.0)], "whole double, visits double, part double, huge double")
    out = clean.restore_integers(df, ("visits",))
    assert dict(out.dtypes) == {"whole": "bigint", "visits": "bigint", "part": "double", "huge": "double"}
    assert rows(out.select("visits")) == [(2,), (3,)]


def test_fill_numeric_options(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (4, 9.0), (None, None)], "item_count int, x double")
    assert rows(clean.fill_numeric(df, words=("count",)))[:2] == [(1, 1.0), (1, 2.0)]
    assert clean.find_numeric_fills(df, "auto", ("count",)) == {"item_count": 1, "x": 2.0}
    assert clean.find_numeric_fills(df, "mean") == {"item_count": 2.0, "x": 4.0}
    assert clean.find_numeric_fills(df, "no such option") == {"item_count": 1.0, "x": 2.0}
    empty = spark.createDataFrame([(None,)], "x double")
    assert clean.find_numeric_fills(empty, "median") == {}
    assert clean.find_numeric_fills(empty, "mode") == {"x": 0}


def test_fractional_fill_widens_a_whole_column(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    out = clean.fill_numeric(df)
    assert out.dtypes == [("n", "double")] and rows(out) == [(1.0,), (1.5,), (2.0,)]


def test_fill_text_options(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "s string, e string")
    assert rows(clean.fill_text(df)) == [("a", "Unknown"), ("a", "Unknown"), ("b", "Unknown")]
    assert rows(clean.fill_text(df, "constant", "?").select("s")) == [("?",), ("a",), ("b",)]
    assert clean.fill_text(df, "drop").count() == 0


def test_caps_skip_named_few_valued_and_flat_columns(spark):
    data = [(float(i), float(i % 4), 1.0 if i < 95 else float(i), i, float(i)) for i in range(99)] + [(1e6, 1e6, 1e6, 10**6, 1e6)]
    df = spark.createDataFrame(data, "x double, few double, flat double, whole bigint, year double")
    caps = clean.find_caps(df)
    assert set(caps) == {"x", "few", "whole"}
    out = clean.cap_outliers(df)
    assert out.agg(F.max("year")).first()[0] == 1e6
    assert out.agg(F.max("x")).first()[0] == pytest.approx(caps["x"]["high"])


def test_cap_keeps_missing_values_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,), (1e9,)], "x double")
    assert clean.cap_outliers(df).where("x is null").count() == 1


def test_duplicate_columns_compare_missing_as_equal(spark):
    df = spark.createDataFrame(
        [(1, 1, 1.0, None, "a"), (None, None, None, 1, "b"), (3, 3, 3.0, 3, "a")], "a int, b int, d double, e int, s string"
    )
    assert clean.find_duplicate_columns(df) == {"b": "a"}


def test_same_values_in_another_order_are_not_duplicates(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert clean.find_duplicate_columns(df) == {}


def test_dedupe_treats_missing_as_equal(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (float("nan"), "x"), (None, "x")], "a double, b string")
    assert clean.dedupe(df).count() == 2


def test_full_run_is_idempotent_and_leaves_no_gaps(spark, sf_dir):
    once = clean_table(table(spark, sf_dir, "dirty_orders")).frame
    twice = clean_table(once)
    assert twice.frame.dtypes == once.dtypes
    assert rows(twice.frame) == rows(once)
    gaps = once.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in once.columns]).first().asDict()
    assert not any(gaps.values()), gaps


def test_run_switches(spark, sf_dir):
    df = table(spark, sf_dir, "dirty_orders")
    off = CleanOptions(**{k: False for k, v in vars(CleanOptions()).items() if isinstance(v, bool)})
    run = clean_table(df, off)
    assert run.frame.dtypes == df.dtypes and run.frame.count() == df.count()
    sparse = clean_table(df, CleanOptions(fill_text=False, drop_sparse=True)).frame
    assert "sparse_status" not in sparse.columns


def test_basic_run_drop_and_identifiers(spark, sf_dir):
    df = table(spark, sf_dir, "dirty_orders").drop("empty_col", "sparse_status")
    run = clean_basic(df, BasicCleanOptions(text_fill="drop", numeric_fill="mean", drop_identifiers=True))
    assert run.frame.where("o_orderstatus is null").count() == 0
    assert "const_region" not in run.frame.columns
    report = {(f[0], f[1]): f[3] for f in run.facts if f[2] is None}
    assert report["total", "rows_after"] == run.frame.count()


def test_report_counts_add_up(spark, sf_dir):
    run = clean_table(table(spark, sf_dir, "dirty_events"))
    facts = {(f[0], f[1]): f[3] for f in run.facts if f[2] is None}
    assert facts["total", "rows_before"] - facts["empty", "removed_rows"] - facts["duplicates", "removed_rows"] == run.frame.count()
    assert facts["total", "rows_after"] == run.frame.count()


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert clean_table(one, CleanOptions(drop_constant=False)).frame.count() == 1
    none = one.limit(0)
    assert clean_table(none, CleanOptions(drop_constant=False)).frame.count() == 0


def test_runs_leave_no_table_behind(spark, monkeypatch):
    import os

    from plumbline.operators import clean_runs
    from plumbline.session import shared_dir

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, s string")
    folder = shared_dir(spark).replace("file:", "")
    here = lambda: {n for n in os.listdir(folder) if n.startswith("deduped")}
    before = here()
    run = clean_table(df)
    assert run.frame.count() == 2 and len(here() - before) == 1
    run.release()
    assert here() == before

    def fails(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(clean_runs, "_settle_columns", fails)
    with pytest.raises(RuntimeError):
        clean_table(df)
    assert here() == before


def test_whole_numbers_need_words(spark):
    df = spark.createDataFrame([(1.5, 2.5), (2.0, 3.0)], "visit_count double, price double")
    with pytest.warns(UserWarning, match="words"):
        assert sorted(map(tuple, clean.clean_integers(df).collect())) == [(1.5, 2.5), (2.0, 3.0)]
    named = clean.clean_integers(df, ("count",))
    assert {tuple(r) for r in named.collect()} == {(None, 2.5), (2.0, 3.0)}
