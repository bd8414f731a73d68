"""What each column is: constant, identifier, date, number, flag, category or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.config import ProfileOptions, name_matches
from plumbline.functions.counts import approx_distinct, distinct_and_mode, groupable, per_column
from plumbline.functions.exprs import to_time
from plumbline.functions.schema import BOOLEAN, DATETIME, NUMERIC, TEXT, col, columns_of, family, nan_to_null

DEFAULT = ProfileOptions()
# Columns whose estimated distinct values are below this share of what the ratio
# asks for cannot pass it: the estimate's standard error is 5 %, and this leaves
# six of them.  Such columns skip the exact count.
NEAR = 0.70


def constant_measures(name: str) -> dict:
    c = col(name)
    rows, present = F.count(F.lit(1)), F.count(c)
    same = F.min(c).eqNullSafe(F.max(c)) & ((present == rows) | (present == 0))
    return {"rows": rows, "missing": rows - present, "is_constant": same}


def constant_columns(df: DataFrame) -> DataFrame:
    """``(column, rows, missing)`` for columns with at most one value, missing included.

    Equal minimum and maximum decide it, so no distinct count is shuffled.
    """
    df = nan_to_null(df)
    return per_column(df, groupable(df), constant_measures, none="rows bigint, missing bigint, is_constant boolean").where("is_constant").drop("is_constant")


def constant_names(df: DataFrame) -> list[str]:
    return [r["column"] for r in constant_columns(df).collect()]


def near_unique(df: DataFrame, columns: list[str], ratio: float) -> list[str]:
    """Columns worth an exact distinct count when looking for a distinct share over ``ratio``.

    The estimate leaves out missing values, which count as one.
    """
    rows, guess = df.count(), approx_distinct(df, columns)
    return [c for c in columns if rows and guess[c] + 1 >= NEAR * ratio * rows]


def identifier_columns(df: DataFrame, options: ProfileOptions = DEFAULT, substring: bool = False) -> DataFrame:
    """``(column, reason, distinct_pct)``: named like an identifier, or nearly all distinct.

    ``distinct_pct`` counts missing as a value and is NULL where the name decided.
    """
    df = nan_to_null(df)
    names = groupable(df)
    by_name = [c for c in names if name_matches(c, options.identifier_words, substring)]
    rest = near_unique(df, [c for c in names if c not in by_name], options.identifier_ratio)
    schema = "column string, reason string, distinct_pct double"
    out = df.sparkSession.createDataFrame([(c, "name", None) for c in by_name], schema)
    if rest:
        rows = df.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
        ratio = F.col("distinct_all") / F.lit(float(rows))
        out = out.unionByName(
            distinct_and_mode(df.select(*map(col, rest)), rest)
            .where(ratio > options.identifier_ratio)
            .select("column", F.lit("distinct").alias("reason"), F.round(ratio * 100, 2).alias("distinct_pct"))
        )
    return out


def identifier_names(df: DataFrame, options: ProfileOptions = DEFAULT) -> list[str]:
    return [r["column"] for r in identifier_columns(df, options).collect()]


def datetime_columns(df: DataFrame, share: float = DEFAULT.date_share) -> DataFrame:
    """``(column, parsed, date_share)``: typed dates, or text that mostly parses as dates."""
    df = nan_to_null(df)
    typed = set(columns_of(df, DATETIME))
    names = columns_of(df, DATETIME, TEXT)

    def measures(c):
        parsed = F.count(col(c) if c in typed else to_time(col(c)))
        return {
            "parsed": parsed,
            "date_share": F.round(F.coalesce(F.try_divide(parsed, F.count(F.lit(1))), F.lit(0.0)), 4),
            "keep": F.lit(c in typed) | (parsed >= F.lit(share) * F.count(F.lit(1))) & (parsed > 0),
        }

    none = "parsed bigint, date_share double, keep boolean"
    return per_column(df, names, measures, none=none).where("keep").drop("keep")


def feature_types(df: DataFrame, options: ProfileOptions = DEFAULT) -> DataFrame:
    """``(column, dtype, role, distinct)`` with roles datetime, numeric, boolean, text, categorical."""
    df = nan_to_null(df)
    dates = {r["column"] for r in datetime_columns(df, options.date_share).collect()}
    names = groupable(df)
    kind = {f.name: family(f.dataType) for f in df.schema.fields}
    rows = [
        (c, df.schema[c].dataType.simpleString(), "datetime" if c in dates else kind[c] if kind[c] in (NUMERIC, BOOLEAN) else "")
        for c in names
    ]
    roles = df.sparkSession.createDataFrame(rows, "column string, dtype string, fixed string")
    by_size = F.when(F.col("distinct") > options.text_distinct, "text").otherwise("categorical")
    return distinct_and_mode(df, names).join(F.broadcast(roles), "column").select(
        "column",
        "dtype",
        F.when(F.col("fixed") != "", F.col("fixed")).otherwise(by_size).alias("role"),
        "distinct",
    )


def chartable_limit(rows: int, floor: int = 5, ceiling: int = 20, share: float = 0.05) -> int:
    return min(ceiling, max(floor, int(rows * share)))


def categorical_columns(df: DataFrame) -> DataFrame:
    """``(column, distinct)`` for columns worth grouping by in a chart: at least two
    values, and text, boolean or a number with few distinct values."""
    df = nan_to_null(df)
    names = columns_of(df, TEXT, BOOLEAN, NUMERIC)
    numeric = columns_of(df, NUMERIC)
    rows = df.count()
    few = chartable_limit(rows)
    return (
        distinct_and_mode(df, names)
        .where((F.col("distinct") >= 2) & (~F.col("column").isin(*numeric) | (F.col("distinct") <= few)))
        .select("column", "distinct")
    )


def categorical_names(df: DataFrame) -> list[str]:
    chosen = {r["column"] for r in categorical_columns(df).collect()}
    return [c for c in df.columns if c in chosen]
