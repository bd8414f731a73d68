"""Type families and boundary normalisation; metadata only, no jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC, TEXT, BOOLEAN, DATETIME, OTHER = "numeric", "text", "boolean", "datetime", "other"


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return OTHER


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def col(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value and -0.0 equals 0.0 for every operator here."""
    fields = df.schema.fields
    if not any(is_float(f.dataType) for f in fields):
        return df
    return df.select(
        *[
            (F.nanvl(col(f.name), F.lit(None)) + F.lit(0.0).cast(f.dataType)).cast(f.dataType).alias(f.name)
            if is_float(f.dataType)
            else col(f.name)
            for f in fields
        ]
    )


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One ``select`` that swaps some columns in place, keeping the order."""
    if not new:
        return df
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])
