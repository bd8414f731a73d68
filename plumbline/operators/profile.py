"""Profiling: what is in a table, how much is missing, and how healthy it is.

Reports are long DataFrames (one row per column, pair or finding), so they stay
queryable.  Work on the data is a fixed number of jobs whatever the column count.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.config import IN_MEMORY_VALUES, HealthByCount, HealthByShare, ProfileOptions
from plumbline.functions.counts import (
    byte_size,
    column_facts,
    distinct_and_mode,
    duplicate_rows,
    groupable,
    per_column,
)
from plumbline.functions.exprs import ladder, percent
from plumbline.functions.moments import pair_moments
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.schema import BOOLEAN, DATETIME, NUMERIC, TEXT, col, columns_of, nan_to_null
from plumbline.operators.roles import constant_measures, identifier_names

DEFAULT = ProfileOptions()


# --- fences ------------------------------------------------------------------


def fences(
    df: DataFrame, columns: list[str], factor: float = DEFAULT.fence_factor, in_memory: int = IN_MEMORY_VALUES
) -> dict[str, dict]:
    """Quartiles and fences per column on the driver (five numbers each)."""
    out = {}
    for c, (q1, median, q3) in exact_quantiles(df, columns, [0.25, 0.5, 0.75], in_memory).items():
        if q1 is None:
            out[c] = {"q1": None, "median": None, "q3": None, "low": None, "high": None}
        else:
            reach = factor * (q3 - q1)
            out[c] = {"q1": q1, "median": median, "q3": q3, "low": q1 - reach, "high": q3 + reach}
    return out


def outside(name: str, fence: dict):
    """Is the value outside its fences?  Never true for a column without values."""
    if fence["low"] is None:
        return F.lit(False)
    return (col(name) < fence["low"]) | (col(name) > fence["high"])


def _double(x):
    return F.lit(x).cast("double")


# --- per-column reports ------------------------------------------------------


def numeric_stats(
    df: DataFrame, columns: list[str] | None = None, digits: int = 4, in_memory: int = IN_MEMORY_VALUES
) -> DataFrame:
    """Count, missing, mean, median, spread, range and quartiles per numeric column.

    Columns of more than ``in_memory`` values get their quartiles by selection.
    """
    df = nan_to_null(df)
    columns = columns or columns_of(df, NUMERIC)
    marks = fences(df, columns, in_memory=in_memory)

    def measures(c):
        v = col(c).cast("double")
        stats = {
            "mean": F.avg(v),
            "median": _double(marks[c]["median"]),
            "std": F.stddev_samp(v),
            "variance": F.var_samp(v),
            "min": F.min(v),
            "max": F.max(v),
            "q1": _double(marks[c]["q1"]),
            "q3": _double(marks[c]["q3"]),
        }
        return {
            "count": F.count(v),
            "missing": F.count_if(v.isNull()),
            **{k: F.round(e, digits) for k, e in stats.items()},
        }

    none = "count bigint, missing bigint, " + ", ".join(f"{k} double" for k in ("mean", "median", "std", "variance", "min", "max", "q1", "q3"))
    return per_column(df, columns, measures, buffers=12, none=none)


def categorical_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, missing, distinct, mode and mode frequency per text or boolean column."""
    df = nan_to_null(df)
    columns = columns or columns_of(df, TEXT, BOOLEAN)
    measures = lambda c: {"count": F.count(col(c)), "missing": F.count_if(col(c).isNull())}
    counts = per_column(df, columns, measures, none="count bigint, missing bigint")
    return counts.join(distinct_and_mode(df, columns), "column").select(
        "column", "count", "missing", "distinct", F.col("top_value").alias("mode"), F.col("top_count").alias("mode_count")
    )


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, options: ProfileOptions = DEFAULT) -> DataFrame:
    """Outlier count, share and fences per numeric column with enough values."""
    df = nan_to_null(df)
    columns = columns or columns_of(df, NUMERIC)
    marks = fences(df, columns, options.fence_factor)

    def measures(c):
        out = F.count_if(outside(c, marks[c]))
        return {
            "values": F.count(col(c)),
            "outliers": out,
            "outlier_pct": percent(out, F.count(col(c))),
            "lower_fence": F.round(_double(marks[c]["low"]), 4),
            "upper_fence": F.round(_double(marks[c]["high"]), 4),
        }

    none = "values bigint, outliers bigint, outlier_pct double, lower_fence double, upper_fence double"
    return per_column(df, columns, measures, none=none).where(F.col("values") >= options.min_values_for_fences)


def missing_analysis(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """Columns with missing values: count, share, severity and a suggested fill."""
    df = nan_to_null(df)
    numeric, dates = columns_of(df, NUMERIC), columns_of(df, DATETIME)

    def measures(c):
        nulls = F.count_if(col(c).isNull())
        fill = "median" if c in numeric else "drop rows" if c in dates else "mode"
        return {"missing": nulls, "missing_pct": percent(nulls, F.count(F.lit(1))), "suggested_fill": F.lit(fill)}

    severity = ladder(
        F.col("missing_pct"), [(options.severity_high, "high"), (options.severity_medium, "medium")], "low"
    )
    return (
        per_column(df, df.columns, measures, none="missing bigint, missing_pct double, suggested_fill string")
        .where("missing > 0")
        .withColumn("severity", severity)
        .orderBy(F.desc("missing_pct"), "column")
    )


def column_profile(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """One row per column: type, missing, distinct, sample, bytes, flags and statistics."""
    df = nan_to_null(df)
    names, numeric = groupable(df), columns_of(df, NUMERIC)
    marks = fences(df, numeric, options.fence_factor)
    dtypes = dict(df.dtypes)

    def measures(c):
        v, rows = col(c), F.count(F.lit(1))
        is_num = c in numeric
        num = v.cast("double") if is_num else F.lit(None).cast("double")
        enough = F.count(v) >= options.min_values_for_fences
        out = F.when(enough, F.count_if(outside(c, marks[c]))).otherwise(0) if is_num else F.lit(None)
        return {
            "rows": rows,
            "dtype": F.lit(dtypes[c]),
            "missing": rows - F.count(v),
            "missing_pct": percent(rows - F.count(v), rows),
            "sample_value": F.min(v).cast("string"),
            "bytes": byte_size(df, c).cast("bigint"),
            "min": F.round(F.min(num), 4),
            "max": F.round(F.max(num), 4),
            "mean": F.round(F.avg(num), 4),
            "median": F.round(_double(marks[c]["median"] if is_num else None), 4),
            "std": F.round(F.stddev_samp(num), 4),
            "outliers": out.cast("bigint"),
        }

    none = "rows bigint, dtype string, missing bigint, missing_pct double, sample_value string, bytes bigint, " + ", ".join(
        f"{k} double" for k in ("min", "max", "mean", "median", "std")
    )
    facts = per_column(df, names, measures, buffers=14, none=f"{none}, outliers bigint")
    is_numeric = F.col("column").isin(*numeric)
    return facts.join(distinct_and_mode(df, names), "column").select(
        "column",
        "dtype",
        "missing",
        "missing_pct",
        "distinct",
        "sample_value",
        "bytes",
        (F.col("distinct_all") <= 1).alias("is_constant"),
        (F.col("distinct") == F.col("rows")).alias("is_identifier"),
        "min",
        "max",
        "mean",
        "median",
        "std",
        "outliers",
        F.when(~is_numeric, F.col("top_value")).alias("top_value"),
        F.when(~is_numeric, F.col("top_count")).alias("top_count"),
    )


def storage_estimate(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """Bytes per column and the saving a narrower encoding might bring (a rule of thumb)."""
    df = nan_to_null(df)
    names = groupable(df)
    numeric, text = columns_of(df, NUMERIC), columns_of(df, TEXT)
    measures = lambda c: {"rows": F.count(F.lit(1)), "bytes": byte_size(df, c).cast("bigint")}
    facts = per_column(df, names, measures, none="rows bigint, bytes bigint")
    share = (
        F.when(F.col("column").isin(*numeric), options.numeric_saving)
        .when(
            F.col("column").isin(*text) & (F.try_divide(F.col("distinct"), F.col("rows")) < options.text_saving_ratio),
            options.text_saving,
        )
        .otherwise(0.0)
    )
    return facts.join(distinct_and_mode(df, names), "column").select(
        "column", "bytes", F.round(F.col("bytes") * share, 2).alias("possible_saving")
    )


# --- correlations ------------------------------------------------------------


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Pearson r for every unordered pair of varying numeric columns.

    All pairs share the scans of ``functions.moments``; rows missing either side
    are skipped per pair.  ``rank`` orders by strength, ``signed_rank`` by r itself.
    """
    df = nan_to_null(df)
    columns = columns or columns_of(df, NUMERIC)
    facts = column_facts(df, columns, lambda c: {"varies": F.coalesce(F.min(col(c)) < F.max(col(c)), F.lit(False))})
    pairs = list(combinations([c for c in columns if facts[c]["varies"]], 2))
    found = [(a, b, m.r) for (a, b), m in pair_moments(df, pairs).items() if m.r is not None]
    r = df.sparkSession.createDataFrame(found, "column_a string, column_b string, r double")
    r = r.withColumn("r", F.round("r", digits))
    return r.select(
        "*",
        F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "column_a", "column_b")).cast("bigint").alias("rank"),
        F.row_number().over(Window.orderBy(F.desc("r"), "column_a", "column_b")).cast("bigint").alias("signed_rank"),
    )


def strong_correlations(df: DataFrame, threshold: float = DEFAULT.strong_correlation) -> DataFrame:
    """Pairs whose r, rounded to three places, is at least ``threshold`` either way."""
    return (
        correlation_matrix(df, digits=3)
        .where(F.abs("r") >= threshold)
        .select("column_a", "column_b", "r")
        .orderBy(F.desc(F.abs("r")), "column_a", "column_b")
    )


# --- whole-table facts and scores --------------------------------------------


def dataset_facts(df: DataFrame, options: ProfileOptions = DEFAULT, identifiers: bool = True) -> DataFrame:
    """One row of whole-table facts that the scores and rules below read.

    Finding identifiers counts distinct values; without ``identifiers`` their
    number is NULL.
    """
    df = nan_to_null(df)
    names = groupable(df)
    facts = column_facts(df, names, lambda c: {**constant_measures(c), "bytes": byte_size(df, c).cast("bigint")})
    rows = next(iter(facts.values()))["rows"] if facts else df.count()
    missing = sum(f["missing"] for f in facts.values())
    duplicates = duplicate_rows(df, rows)
    cells = rows * len(names)
    data = {
        "rows": rows,
        "columns": len(df.columns),
        "missing_cells": missing,
        "missing_pct": missing / cells * 100 if cells else 0.0,
        "duplicate_rows": duplicates,
        "duplicate_pct": duplicates / rows * 100 if rows else 0.0,
        "empty_columns": sum(f["missing"] == rows for f in facts.values()),
        "constant_columns": sum(bool(f["is_constant"]) for f in facts.values()),
        "identifier_columns": len(identifier_names(df, options)) if identifiers else None,
        "numeric_columns": len(columns_of(df, NUMERIC)),
        "text_columns": len(columns_of(df, TEXT)),
        "boolean_columns": len(columns_of(df, BOOLEAN)),
        "datetime_columns": len(columns_of(df, DATETIME)),
        "storage_bytes": sum(f["bytes"] for f in facts.values()),
    }
    schema = ", ".join(f"{k} {'double' if k.endswith('pct') else 'bigint'}" for k in data)
    out = df.sparkSession.createDataFrame([tuple(data.values())], schema)
    return out.withColumns({k: F.round(k, 2) for k in ("missing_pct", "duplicate_pct")})


def dataset_summary(df: DataFrame) -> DataFrame:
    return dataset_facts(df, identifiers=False).drop("empty_columns", "constant_columns", "identifier_columns", "duplicate_pct")


def quality_counts(df: DataFrame) -> DataFrame:
    return dataset_facts(df, identifiers=False).select("empty_columns", "constant_columns", "duplicate_rows", "missing_cells")


def duplicate_analysis(df: DataFrame) -> DataFrame:
    """Duplicate rows, their share, and whether there are any."""
    df = nan_to_null(df)
    rows = df.count()
    facts = df.sparkSession.createDataFrame([(rows, duplicate_rows(df, rows))], "rows bigint, duplicate_rows bigint")
    return facts.select(
        "duplicate_rows",
        percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"),
        (F.col("duplicate_rows") > 0).alias("has_duplicates"),
    )


def health_by_count(facts: DataFrame, w: HealthByCount = HealthByCount()) -> DataFrame:
    """Score from absolute counts; saturates on large tables."""
    loss = (
        F.least(F.col("missing_cells") * w.per_missing_cell, F.lit(w.missing_cap))
        + F.least(F.col("duplicate_rows") * w.per_duplicate, F.lit(w.duplicate_cap))
        + F.col("empty_columns") * w.per_empty_column
        + F.col("constant_columns") * w.per_constant_column
    )
    return facts.select(F.round(F.greatest(F.lit(100.0) - loss, F.lit(0.0)), 2).alias("health_score"))


def share_score(w: HealthByShare = HealthByShare()) -> Column:
    """Score from shares, over the columns of ``dataset_facts``."""
    loss = (
        F.least(F.col("missing_pct") * w.per_missing_pct, F.lit(w.missing_cap))
        + F.least(F.col("duplicate_pct") * w.per_duplicate_pct, F.lit(w.duplicate_cap))
        + F.col("constant_columns") * w.per_constant_column
        + F.col("identifier_columns") * w.per_identifier_column
    )
    return F.round(F.least(F.greatest(F.lit(100.0) - loss, F.lit(0.0)), F.lit(100.0)), 2)


def health_by_share(facts: DataFrame, w: HealthByShare = HealthByShare()) -> DataFrame:
    """Score from shares, with a grade and a label; the default score."""
    return facts.select(share_score(w).alias("health_score")).select(
        "health_score",
        ladder(F.col("health_score"), [(t, g) for t, g, _ in w.grades]).alias("grade"),
        ladder(F.col("health_score"), [(t, label) for t, _, label in w.grades]).alias("label"),
    )


def readiness(facts: DataFrame, w: HealthByShare = HealthByShare()) -> DataFrame:
    return health_by_share(facts, w).select(
        "health_score", ladder(F.col("health_score"), w.readiness).alias("readiness")
    )
