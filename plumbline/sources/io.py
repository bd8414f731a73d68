"""Reading and writing: tables, reports, previews and fitted models."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.config import LOAD_TOKENS
from plumbline.functions.exprs import tokens_to_null
from plumbline.functions.schema import col, nan_to_null, replace_columns
from plumbline.operators.clean import trim_names
from plumbline.sources import quoted
from plumbline.sources.lattice import typed, types_by_content

# File extensions and the Spark format that reads them.
FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def load(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
    missing: tuple[str, ...] = LOAD_TOKENS, keep_zeros: bool = True, ragged: str = "error", **options,
) -> DataFrame:
    """Read one table, choosing the format by extension.

    CSV has a header row, a quote inside quotes is written twice, and quoted cells may
    hold line breaks; files are split all the same.  Without a ``schema``, spellings of
    "no value" (``missing``) become NULL and then one more pass finds the narrowest
    type that keeps every value of a column (``keep_zeros``: 007 stays text).

    A row with more cells than the header is an error that shows it, and rows with fewer
    are filled with NULL under a warning that counts them; with ``ragged="column"`` both
    are kept, and ``_record`` holds their whole text (NULL for all other rows).  CSV options
    other than ``sep`` and ``quote`` go to Spark's own reader, which ends a row at each line.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = fmt or FORMATS.get(ext)
    if fmt is None:
        raise ValueError(f"no reader for {path!r}; expected one of {', '.join(sorted(FORMATS))}")
    if fmt != "csv":
        reader = spark.read.format(fmt) if schema is None else spark.read.format(fmt).schema(schema)
        return nan_to_null(trim_names(reader.options(**options).load(path)))
    options = {"sep": "\t" if ext == ".tsv" else ",", "quote": '"', "escape": '"', "nanValue": "NaN"} | options
    plain = set(options) == {"sep", "quote", "escape", "nanValue"} and options["escape"] == '"'
    if plain:
        df = _from_records(spark, path, schema, ragged, options)
    else:
        reader = spark.read.options(**{"header": True, "mode": "PERMISSIVE"} | options)
        df = (reader if schema is None else reader.schema(schema)).csv(path)
    df = trim_names(df)
    if schema is None:
        cells = [c for c in df.columns if c not in (RECORD, _SHORT)]
        df = replace_columns(df, {c: tokens_to_null(col(c), missing) for c in cells})
        also = {"short": F.count_if(col(_SHORT))} if _SHORT in df.columns else {}
        types, found = types_by_content(df.select(*[col(c) for c in cells], *[col(c) for c in (_SHORT,) if also]), keep_zeros, also)
        df = typed(df, types)
        if found.get("short") and ragged == "error":
            warnings.warn(f"{found['short']} rows of {path!r} have fewer cells than the header; the others are NULL", stacklevel=2)
    return nan_to_null(df.drop(_SHORT))


#: The whole text of rows with another number of cells than the header; and a mark used while loading.
RECORD, _SHORT = "_record", "_plumbline_short"


def _from_records(spark: SparkSession, path: str, schema: T.StructType | str | None, ragged: str, options: dict) -> DataFrame:
    """The table of the records under ``path``, text in every column unless a schema is given."""
    if ragged not in ("error", "column"):
        raise ValueError(f"ragged is 'error' or 'column', not {ragged!r}")
    if schema is None:
        # Spark's names: blank and repeated ones numbered; only the first record is read.
        names = spark.read.options(**options, header=True, multiLine=True).csv(path).columns
        types = [T.StringType()] * len(names)
    else:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        names, types = [f.name for f in fields], [f.dataType for f in fields]
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    rows = quoted.records(spark, path, options["sep"], options["quote"]).where(~F.col("first"))
    cells, n = F.col("cells"), len(names)
    record = F.col("record")
    if ragged == "error":
        say = F.concat(F.lit(f"a row has more than the {n} cells of the header: "), F.substring("record", 1, 200))
        record = F.when(cells > n, F.raise_error(say)).otherwise(record)
    ddl = ", ".join(f"c{i} {t.simpleString()}" for i, t in enumerate(types))
    parsed = F.from_csv(record, ddl, options | {"mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1"})
    rows = rows.select(parsed.alias("row"), "record", "cells")
    out = rows.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)],
        *([F.when(cells != n, F.col("record")).alias(RECORD)] if ragged == "column" else []),
        *([(cells < n).alias(_SHORT)] if schema is None else []),
    )
    return out


def save_table(df: DataFrame, directory: str, name: str = "cleaned", fmt: str = "parquet", mode: str = "error") -> str:
    path = f"{directory.rstrip('/')}/{name}.{fmt}"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)
    return path


def save_report(report: DataFrame, directory: str, name: str = "cleaning_report", mode: str = "error") -> str:
    """A report is a few rows per column, so one file holds it."""
    path = f"{directory.rstrip('/')}/{name}.json"
    report.coalesce(1).write.mode(mode).json(path)
    return path


def preview(df: DataFrame, order_by: list[str], rows: int = 100) -> DataFrame:
    """First rows by key, every value as text and missing as empty text."""
    top = nan_to_null(df).orderBy(*[col(c) for c in order_by]).limit(rows)
    return top.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
