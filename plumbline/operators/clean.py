"""Cleaning steps, each ``DataFrame -> DataFrame``.

Steps whose result type depends on the data are split in two: a ``find_*``
function that runs one aggregate and returns a decision per column, and an
apply step that is a plain lazy ``select``.
"""

from __future__ import annotations

import math
import re
import warnings

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.config import (
    CASE_SENSITIVE_WORDS,
    CLEAN_TOKENS,
    INTEGER_WORDS,
    LOAD_TOKENS,
    UNCAPPED_WORDS,
    ProfileOptions,
    name_matches,
)
from plumbline.functions.counts import column_facts, groupable, modes, with_distinct
from plumbline.functions.exprs import (
    currency_to_number,
    epoch_micros,
    fraction_of,
    strip_symbols,
    title_case,
    to_number,
    to_time,
    tokens_to_null,
)
from plumbline.functions.quantiles import exact_quantiles
from plumbline.functions.schema import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    col,
    columns_of,
    is_float,
    nan_to_null,
    replace_columns,
)
from plumbline.operators.profile import fences, outside
from plumbline.operators.roles import constant_names, identifier_names

WHOLE_TOLERANCE = 1e-8
ROUND_TOLERANCE = 1e-3
# Doubles beyond this cannot hold every whole number, so they stay doubles.
MAX_WHOLE = float(2**53)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_float(f.dataType)]


# --- names and columns -------------------------------------------------------


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def tidy_name(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[\s-]", "_", name.strip())).strip("_") or "column"


def standardize_names(df: DataFrame) -> DataFrame:
    """Spaces and hyphens become single underscores; names that collide get a number."""
    used: set[str] = set()
    names = []
    for base in map(tidy_name, df.columns):
        name, i = base, 2
        while name.lower() in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def drop_named(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns; names that do not exist are ignored."""
    return df.drop(*names)


def drop_constant_columns(df: DataFrame) -> DataFrame:
    return df.drop(*constant_names(df))


def drop_identifier_columns(df: DataFrame, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    return df.drop(*identifier_names(df, options))


def find_sparse(df: DataFrame, share: float = 0.80) -> list[str]:
    facts = column_facts(
        df, df.columns, lambda c: {"rows": F.count(F.lit(1)), "missing": F.count_if(col(c).isNull())}
    )
    return [c for c, f in facts.items() if f["rows"] and f["missing"] >= share * f["rows"]]


def drop_sparse_columns(df: DataFrame, share: float = 0.80) -> DataFrame:
    return df.drop(*find_sparse(nan_to_null(df), share))


def fingerprint_measures(c: Column) -> dict[str, Column]:
    """Order-free summary that equal columns share; filters pairs before comparing rows."""
    h = F.xxhash64(c)
    return {
        "missing": F.count_if(c.isNull()),
        "xor": F.bit_xor(h),
        # a sum of decimal(28) has 38 digits, enough for any number of 19-digit hashes
        "sum": F.sum(h.cast("decimal(28,0)")).cast("string"),
    }


def equal_pairs(df: DataFrame, facts: dict, values: dict[str, Column] | None = None) -> dict[str, str]:
    """``{later column: earlier equal column}`` among columns with equal fingerprints."""
    values = values or {c: col(c) for c in facts}
    types = {c: df.select(values[c].alias("v")).schema["v"].dataType.simpleString() for c in facts}
    groups: dict[tuple, list[str]] = {}
    for c in facts:
        groups.setdefault((types[c], facts[c]["missing"], facts[c]["xor"], facts[c]["sum"]), []).append(c)
    same: dict[str, str] = {}
    todo = [g for g in groups.values() if len(g) > 1]
    while todo:
        # every column against the first of its group; those that differ form a group of their own
        pairs = {b: g[0] for g in todo for b in g[1:]}
        found = column_facts(df, list(pairs), lambda b: {"equal": F.every(values[pairs[b]].eqNullSafe(values[b]))}, buffers=1)
        same |= {b: a for b, a in pairs.items() if found[b]["equal"]}
        todo = [rest for g in todo if len(rest := [c for c in g[1:] if c not in same]) > 1]
    return same


def find_duplicate_columns(df: DataFrame) -> dict[str, str]:
    df = nan_to_null(df)
    return equal_pairs(df, column_facts(df, groupable(df), lambda c: fingerprint_measures(col(c))))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """``(column, same_as)`` for every column equal, row by row, to an earlier one."""
    rows = list(find_duplicate_columns(df).items())
    return df.sparkSession.createDataFrame(rows, "column string, same_as string")


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    return df.drop(*find_duplicate_columns(df))


# --- rows --------------------------------------------------------------------


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return nan_to_null(df).na.drop("all")


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return nan_to_null(df).na.drop(subset=columns)


def dedupe(df: DataFrame) -> DataFrame:
    """One of each set of equal rows.  Partial aggregation folds hot rows before the shuffle."""
    df = nan_to_null(df)
    return df.dropDuplicates(groupable(df))


def outlier_rows(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows whose value lies outside the fences; the fences are two literals in the filter."""
    fence = fences(nan_to_null(df), [column], factor)[column]
    if fence["low"] is None:
        return nan_to_null(df).where(F.lit(False))
    # on the column as stored, so that the scan skips what lies within; NaN sorts above all numbers
    far = (col(column) < fence["low"]) | (col(column) > fence["high"])
    return nan_to_null(df.where(far)).where(outside(column, fence))


# --- text --------------------------------------------------------------------


def normalize_missing(df: DataFrame, tokens: tuple[str, ...] = LOAD_TOKENS) -> DataFrame:
    """Trim text; spellings of "no value" become NULL, and NULL stays NULL."""
    return replace_columns(nan_to_null(df), {c: tokens_to_null(col(c), tokens) for c in columns_of(df, TEXT)})


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = CLEAN_TOKENS) -> DataFrame:
    return replace_columns(df, {c: F.when(~col(c).isin(*tokens), col(c)) for c in columns_of(df, TEXT)})


def clean_strings(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Trim text and strip symbols at both ends; a number keeps its sign."""
    return replace_columns(df, {c: strip_symbols(col(c), ascii_only) for c in columns_of(df, TEXT)})


def title_columns(df: DataFrame, words: tuple[str, ...] = CASE_SENSITIVE_WORDS, substring: bool = False) -> list[str]:
    return [c for c in columns_of(df, TEXT) if not name_matches(c, words, substring)]


def title_case_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = title_columns(df) if columns is None else columns
    return replace_columns(df, {c: title_case(col(c)) for c in columns})


def find_numeric_text(df: DataFrame, share: float = 0.80) -> dict[str, int]:
    """Text columns to retype, with the number of values that do not parse."""
    facts = column_facts(
        df,
        columns_of(df, TEXT),
        lambda c: {"rows": F.count(F.lit(1)), "present": F.count(col(c)), "parsed": F.count(to_number(col(c)))},
    )
    return {c: f["present"] - f["parsed"] for c, f in facts.items() if f["parsed"] and f["parsed"] >= share * f["rows"]}


def numeric_strings(df: DataFrame, share: float = 0.80) -> DataFrame:
    """Text that is a number in at least ``share`` of all rows becomes double."""
    return replace_columns(df, {c: to_number(col(c)) for c in find_numeric_text(df, share)})


def find_date_text(df: DataFrame, share: float = 0.80) -> list[str]:
    facts = column_facts(
        df, columns_of(df, TEXT), lambda c: {"rows": F.count(F.lit(1)), "parsed": F.count(to_time(col(c)))}
    )
    return [c for c, f in facts.items() if f["parsed"] and f["parsed"] >= share * f["rows"]]


def convert_dates(df: DataFrame, share: float = 0.80) -> DataFrame:
    """Text that is a date in at least ``share`` of all rows becomes a timestamp."""
    return replace_columns(df, {c: to_time(col(c)) for c in find_date_text(df, share)})


def parse_currency(df: DataFrame, columns: list[str], scale_suffix: bool = True) -> DataFrame:
    return replace_columns(df, {c: currency_to_number(col(c), scale_suffix) for c in columns})


# --- numbers -----------------------------------------------------------------


def infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def finite(c: Column) -> Column:
    return F.when(~infinite(c), c)


def replace_infinite(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    return replace_columns(df, {c: finite(col(c)) for c in float_columns(df)})


def integer_columns(df: DataFrame, words: tuple[str, ...] = INTEGER_WORDS, substring: bool = False) -> list[str]:
    return [c for c in float_columns(df) if name_matches(c, words, substring)]


def fractional(c: Column) -> Column:
    return F.pmod(c, F.lit(1.0)) > WHOLE_TOLERANCE


def whole_only(c: Column) -> Column:
    return F.when(~fractional(c), c)


def clean_integers(df: DataFrame, words: tuple[str, ...] = INTEGER_WORDS, substring: bool = False) -> DataFrame:
    """Fractional values of whole-number quantities become NULL.

    A column is such a quantity when its name has one of ``words``.  None are built
    in: without them the table comes back as it is, with a warning.
    """
    if not words:
        warnings.warn("clean_integers does nothing without words that name whole-number quantities", stacklevel=2)
    df = nan_to_null(df)
    return replace_columns(df, {c: whole_only(col(c)) for c in integer_columns(df, words, substring)})


def find_whole_columns(df: DataFrame, words: tuple[str, ...] = INTEGER_WORDS, substring: bool = False) -> list[str]:
    """Float columns that hold only whole numbers, or nearly so where the name says they should."""
    names = float_columns(df)
    facts = column_facts(
        df,
        names,
        lambda c: {"n": F.count(col(c)), "off": F.max(fraction_of(col(c))), "size": F.max(F.abs(col(c)))},
    )
    named = set(integer_columns(df, words, substring))
    return [
        c
        for c, f in facts.items()
        if f["n"] and f["size"] <= MAX_WHOLE and f["off"] <= (ROUND_TOLERANCE if c in named else 0.0)
    ]


def to_whole(c: Column) -> Column:
    return F.rint(c).cast("bigint")


def restore_integers(df: DataFrame, words: tuple[str, ...] = INTEGER_WORDS) -> DataFrame:
    """Float columns of whole numbers become bigint; nearly whole ones only where ``words`` name them."""
    df = nan_to_null(df)
    return replace_columns(df, {c: to_whole(col(c)) for c in find_whole_columns(df, words)})


def bools_to_ints(df: DataFrame) -> DataFrame:
    return replace_columns(df, {c: col(c).cast("int") for c in columns_of(df, BOOLEAN)})


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Model inputs: anything that is not a finite number becomes 0."""
    text = columns_of(df, TEXT)
    new = {c: to_number(col(c)) if c in text else col(c).cast("double") for c in columns}
    return replace_columns(df, {c: F.coalesce(finite(F.nanvl(v, F.lit(None))), F.lit(0.0)) for c, v in new.items()})


def epoch_features(df: DataFrame) -> DataFrame:
    """Dates and timestamps become microseconds since 1970."""
    return replace_columns(df, {c: epoch_micros(col(c)) for c in columns_of(df, DATETIME)})


# --- filling and capping -----------------------------------------------------


def missing_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    facts = column_facts(df, columns, lambda c: {"missing": F.count_if(col(c).isNull())})
    return {c: facts[c]["missing"] for c in columns}


def find_numeric_fills(
    df: DataFrame,
    how: str = "auto",
    words: tuple[str, ...] = INTEGER_WORDS,
    substring: bool = False,
    missing: dict[str, int] | None = None,
) -> dict[str, float]:
    """Fill value per numeric column that has missing values.

    ``auto`` takes the mode for whole-number quantities and the median otherwise;
    ``mean``, ``median`` and ``mode`` apply to every column, and any other word
    means ``median``.  A column without values has no fill, except 0 under ``mode``.
    """
    missing = missing_counts(df, columns_of(df, NUMERIC)) if missing is None else missing
    need = [c for c in columns_of(df, NUMERIC) if missing[c]]
    if how == "auto":
        by_mode = [c for c in need if name_matches(c, words, substring)]
    else:
        by_mode = need if how == "mode" else []
    rest = [c for c in need if c not in by_mode]
    fills = dict(modes(df, by_mode)) if by_mode else {}
    if how == "mode":
        fills = {c: 0 if v is None else v for c, v in fills.items()}
    if how == "mean":
        fills |= {c: r["m"] for c, r in column_facts(df, rest, lambda c: {"m": F.avg(col(c))}).items()}
    else:
        fills |= {c: q[0] for c, q in exact_quantiles(df, rest, [0.5]).items()}
    return {c: v for c, v in fills.items() if v is not None}


def filled(df: DataFrame, name: str, value) -> Column:
    """Column with missing values filled; a fractional fill widens whole types to double."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType) and not float(value).is_integer():
        return F.coalesce(col(name).cast("double"), F.lit(float(value)))
    return F.coalesce(col(name), F.lit(value).cast(dtype))


def apply_fills(df: DataFrame, fills: dict) -> DataFrame:
    return replace_columns(df, {c: filled(df, c, v) for c, v in fills.items()})


def fill_numeric(df: DataFrame, how: str = "auto", words: tuple[str, ...] = INTEGER_WORDS) -> DataFrame:
    df = nan_to_null(df)
    return apply_fills(df, find_numeric_fills(df, how, words))


def find_text_fills(
    df: DataFrame,
    how: str = "mode",
    fallback: str = "Unknown",
    missing: dict[str, int] | None = None,
) -> dict[str, str]:
    """Fill text per text column that has missing values: its mode, or a constant."""
    missing = missing_counts(df, columns_of(df, TEXT)) if missing is None else missing
    need = [c for c in columns_of(df, TEXT) if missing[c]]
    found = modes(df, need) if how == "mode" and need else {}
    return {c: fallback if found.get(c) is None else found[c] for c in need}


def fill_text(df: DataFrame, how: str = "mode", fallback: str = "Unknown") -> DataFrame:
    """Fill missing text by ``mode`` or ``constant``, or ``drop`` the rows."""
    text = columns_of(df, TEXT)
    if how == "drop":
        return df.na.drop(subset=text)
    return replace_columns(
        df, {c: F.coalesce(col(c), F.lit(v)) for c, v in find_text_fills(df, how, fallback).items()}
    )


def find_caps(
    df: DataFrame,
    words: tuple[str, ...] = UNCAPPED_WORDS,
    factor: float = 1.5,
    min_distinct: int = 5,
    substring: bool = False,
) -> dict[str, dict]:
    """Fences and outlier counts of the numeric columns that have outliers to cap."""
    names = [c for c in columns_of(df, NUMERIC) if not name_matches(c, words, substring)]
    names = with_distinct(df, names, min_distinct)
    marks = {c: m for c, m in fences(df, names, factor).items() if m["q1"] is not None and m["q1"] != m["q3"]}
    facts = column_facts(df, list(marks), lambda c: {"n": F.count_if(outside(c, marks[c]))})
    return {c: {**m, "outliers": facts[c]["n"]} for c, m in marks.items() if facts[c]["n"]}


def capped(df: DataFrame, name: str, cap: dict) -> Column:
    dtype = df.schema[name].dataType
    whole = isinstance(dtype, T.IntegralType) and not any(math.modf(cap[k])[0] for k in ("low", "high"))
    kind = T.DoubleType() if isinstance(dtype, T.IntegralType) and not whole else dtype
    c, low, high = (x.cast(kind) for x in (col(name), F.lit(cap["low"]), F.lit(cap["high"])))
    return F.when(col(name) < cap["low"], low).when(col(name) > cap["high"], high).otherwise(c)


def cap_outliers(df: DataFrame, words: tuple[str, ...] = UNCAPPED_WORDS, factor: float = 1.5) -> DataFrame:
    """Pull values beyond the fences back to them; missing values stay missing."""
    df = nan_to_null(df)
    return replace_columns(df, {c: capped(df, c, cap) for c, cap in find_caps(df, words, factor).items()})
