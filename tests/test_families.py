"""Every profiling and chart operator on tables that lack type families, columns or rows."""

import pytest

from plumbline.operators import advice, charts, clean, profile, roles

TABLES = {
    "numeric": ([(i, i * 1.5, i % 7) for i in range(40)], "a int, b double, c bigint"),
    "text": ([(f"v{i % 9}", f"name {i}") for i in range(40)], "a string, b string"),
    "array": ([([i, 1],) for i in range(6)], "a array<int>"),
    "no rows": ([], "a int, b string, c double, d date"),
    "no columns": ([(), ()], ""),
    "all missing": ([(None, None)] * 4, "a int, b string"),
}
OPERATORS = {
    "feature_types": roles.feature_types, "datetime_columns": roles.datetime_columns, "identifier_columns": roles.identifier_columns,
    "constant_columns": roles.constant_columns, "categorical_columns": roles.categorical_columns,
    "numeric_stats": profile.numeric_stats, "categorical_stats": profile.categorical_stats, "iqr_outliers": profile.iqr_outliers,
    "missing_analysis": profile.missing_analysis, "column_profile": profile.column_profile, "storage_estimate": profile.storage_estimate,
    "correlation_matrix": profile.correlation_matrix, "dataset_summary": profile.dataset_summary, "quality_counts": profile.quality_counts,
    "duplicate_analysis": profile.duplicate_analysis,
    "quality_warnings": advice.quality_warnings, "feature_suggestions": advice.feature_suggestions,
    "cleaning_plan": lambda df: advice.cleaning_plan(advice.table_counts(df)),
    "processing_log": lambda df: advice.processing_log(advice.table_counts(df)),
    "target_candidates": advice.target_candidates, "model_suggestion": advice.model_suggestion,
    "category_counts": charts.category_counts, "category_share": charts.category_share, "topk_categories": charts.topk_categories,
    "two_level_counts": charts.two_level_counts, "trend_lines": charts.trend_lines, "trend_summaries": charts.trend_summaries,
    "histogram_bins": charts.histogram_bins, "density": charts.density, "box_stats": charts.box_stats, "box_points": charts.box_points,
    "violin_stats": charts.violin_stats, "missing_bars": charts.missing_bars, "scatter_ols": charts.scatter_ols,
}


def frame(spark, name):
    rows, schema = TABLES[name]
    if not schema:
        return spark.createDataFrame([(1,), (2,)], "x int").drop("x")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def whole(spark):
    """The schema of each operator's result on a table that has every family."""
    rows = [(i, f"t{i % 3}", i * 0.5, i % 2 == 0, f"2024-01-{i % 28 + 1:02d}", i % 7 * 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, s string, x double, f boolean, day string, y double")
    return {k: op(df).schema.simpleString() for k, op in OPERATORS.items()}


@pytest.mark.parametrize("name", TABLES)
def test_operators_take_tables_without_some_family(spark, whole, name):
    df = frame(spark, name)
    for k, op in OPERATORS.items():
        out = op(df)
        assert out.schema.simpleString() == whole[k], k
        out.collect()


def test_identifiers_at_any_ratio(spark):
    df = spark.createDataFrame([(i % 65, None if i else 1) for i in range(100)], "a int, b int")
    named = lambda ratio: {r["column"] for r in roles.identifier_columns(df, profile.ProfileOptions(identifier_ratio=ratio)).collect()}
    assert named(0.6) == {"a"} and named(0.7) == set() and named(0.01) == {"a", "b"}
    tiny = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert [r["column"] for r in roles.identifier_columns(tiny).collect()] == ["a"]


def test_many_equal_columns_are_found_in_linear_work(spark):
    df = spark.createDataFrame([(None,) * 60 for _ in range(10)], ", ".join(f"c{i} int" for i in range(60)))
    assert clean.find_duplicate_columns(df) == {f"c{i}": "c0" for i in range(1, 60)}


def test_dates_in_more_spellings(spark):
    texts = ["2024-01-05T10:20:30.123Z", "2024-01-05 10:20:30.5", "2024-01-05T10:20:30+02:00", "5/1/2024", "05-01-2024", "5/x/2024", "2024-13-01"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(clean.to_time(clean.col("s")).cast("string").alias("t"))
    want = ["2024-01-05 10:20:30.123", "2024-01-05 10:20:30.5", "2024-01-05 08:20:30", "2024-05-01 00:00:00", "2024-01-05 00:00:00", None, None]
    assert [r["t"] for r in df.collect()] == want


def test_outlier_filters_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CAST(id % 10 AS DOUBLE) + IF(id = 7, 1000, 0) AS x").write.parquet(str(tmp_path / "t"))
    out = clean.outlier_rows(spark.read.parquet(str(tmp_path / "t")), "x")
    assert [r["id"] for r in out.collect()] == [7]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(x" in plan
