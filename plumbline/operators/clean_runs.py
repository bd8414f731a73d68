"""Whole cleaning runs: the steps of ``operators.clean`` in a fixed order, with a report.

The run decides first and applies lazily.  Decisions that do not depend on each
other share one pass, and the deduplicated table is written once, because every
later decision would otherwise repeat the widest shuffle of the run.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.config import BasicCleanOptions, CleanOptions
from plumbline.functions.counts import column_facts, groupable
from plumbline.functions.exprs import title_case, to_time
from plumbline.functions.schema import BOOLEAN, NUMERIC, TEXT, col, columns_of, nan_to_null, replace_columns
from plumbline.operators import clean
from plumbline.operators.roles import constant_names, identifier_names
from plumbline.session import materialize, release

REPORT_SCHEMA = "seq bigint, step string, metric string, subject string, value bigint"


@dataclass
class Cleaned:
    frame: DataFrame
    facts: list[tuple]
    written: DataFrame | None = None

    def release(self) -> None:
        """Delete the table the run has written; ``frame`` cannot be read afterwards."""
        if self.written is not None:
            release(self.written)

    def report(self, spark: SparkSession) -> DataFrame:
        """``(seq, step, metric, subject, value)``, one row per fact; ``subject`` is a column or NULL."""
        return spark.createDataFrame([(i, *f) for i, f in enumerate(self.facts)], REPORT_SCHEMA)


class _Log(list):
    def add(self, step, metric, value, subject=None):
        self.append((step, metric, subject, int(value)))

    def columns(self, step, metric, counts: dict):
        for c, n in counts.items():
            self.add(step, metric, n, c)


def clean_table(df: DataFrame, options: CleanOptions = CleanOptions()) -> Cleaned:
    """The full run: names, text, types, rows, fills, caps, columns; each step switchable."""
    o, log = options, _Log()
    df = nan_to_null(df)
    columns_before = len(df.columns)
    if o.standardize_names:
        tidy = clean.standardize_names(df)
        log.add("names", "renamed_columns", sum(a != b for a, b in zip(df.columns, tidy.columns)))
        df = tidy
    if o.clean_strings:
        df = clean.clean_strings(df)
        log.add("strings", "text_columns", len(columns_of(df, TEXT)))
    if o.null_tokens:
        df = clean.null_tokens(df, o.tokens)
    raw_text = columns_of(df, TEXT)
    if o.numeric_strings:
        numeric_text = clean.find_numeric_text(df, o.numeric_share)
        df = replace_columns(df, {c: clean.to_number(col(c)) for c in numeric_text})
        log.columns("numeric_strings", "unparsable", numeric_text)

    df, rows_before, rows = _rowwise_numbers(df, raw_text, o, log)
    with _deduped(df, o.drop_duplicates) as (df, written):
        if o.drop_duplicates:
            log.add("duplicates", "removed_rows", rows - (rows := df.count()))
        df = _fill_and_cap(df, o, log)
        df = _settle_columns(df, o, log)
    log.add("total", "rows_before", rows_before)
    log.add("total", "rows_after", rows)
    log.add("total", "columns_before", columns_before)
    log.add("total", "columns_after", len(df.columns))
    return Cleaned(df, list(log), written)


@contextmanager
def _deduped(df, wanted):
    """The distinct rows, written once, and that table; a run that fails leaves none behind."""
    written = materialize(clean.dedupe(df), "deduped") if wanted else None
    try:
        yield (written if wanted else df), written
    except Exception:
        if wanted:
            release(written)
        raise


def _rowwise_numbers(df, raw_text, o, log):
    """Infinities and fractional counts in one pass, then empty rows.

    The first pass leaves out the cleaned text.  The second filters on the other
    columns first, so text is only cleaned in rows that have nothing else.
    """
    floats = clean.float_columns(df) if o.replace_infinite else []
    whole = clean.integer_columns(df, o.integer_words, o.substring_names) if o.clean_integers else []
    value = {c: clean.finite(col(c)) if c in floats else col(c) for c in df.columns}
    final = {c: clean.whole_only(v) if c in whole else v for c, v in value.items()}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(clean.infinite(col(c))).alias(f"inf{i}") for i, c in enumerate(floats)],
        *[F.count_if(clean.fractional(value[c])).alias(f"frac{i}") for i, c in enumerate(whole)],
    ).first()
    log.columns("infinite", "replaced", {c: row[f"inf{i}"] for i, c in enumerate(floats) if row[f"inf{i}"]})
    log.columns("integers", "fractional", {c: row[f"frac{i}"] for i, c in enumerate(whole) if row[f"frac{i}"]})
    df = replace_columns(df, {c: final[c] for c in {*floats, *whole}})
    rows = row["rows"]
    if o.drop_empty_rows:
        bare = df
        for c in sorted(df.columns, key=lambda c: c in raw_text):
            bare = bare.where(col(c).isNull())
        empty = bare.count()
        if empty:
            df, rows = df.na.drop("all"), rows - empty
            log.add("empty", "removed_rows", empty)
    return df, row["rows"], rows


def _fill_and_cap(df, o, log):
    missing = clean.missing_counts(df, columns_of(df, NUMERIC, TEXT))
    if o.fill_numeric:
        fills = clean.find_numeric_fills(df, "auto", o.integer_words, o.substring_names, missing)
        df = clean.apply_fills(df, fills)
        log.columns("fill_numeric", "filled", {c: missing[c] for c in fills})
    if o.cap_outliers:
        caps = clean.find_caps(df, o.uncapped_words, o.fence_factor, o.min_distinct_for_cap, o.substring_names)
        df = replace_columns(df, {c: clean.capped(df, c, cap) for c, cap in caps.items()})
        log.columns("cap_outliers", "capped", {c: cap["outliers"] for c, cap in caps.items()})
    if o.fill_text:
        fills = clean.find_text_fills(df, "mode", o.fallback_text, missing)
        df = replace_columns(df, {c: F.coalesce(col(c), F.lit(v)) for c, v in fills.items()})
        log.columns("fill_text", "filled", {c: missing[c] for c in fills})
    if o.restore_integers:
        whole = clean.find_whole_columns(df, o.integer_words, o.substring_names)
        df = replace_columns(df, {c: clean.to_whole(col(c)) for c in whole})
        log.columns("restore_integers", "restored", dict.fromkeys(whole, 1))
    return df


def _settle_columns(df, o, log):
    """Title case, then drop or retype columns; one pass gathers what all of it needs."""
    titled = clean.title_columns(df, o.case_words, o.substring_names) if o.title_case else []
    value = {c: title_case(col(c)) if c in titled else col(c) for c in df.columns}
    text, names = columns_of(df, TEXT), groupable(df)

    def measures(c):
        v, rows = value[c], F.count(F.lit(1))
        return {
            "rows": rows,
            "changed": F.count_if(v != col(c)) if c in titled else F.lit(0).cast("bigint"),
            "same": F.min(v).eqNullSafe(F.max(v)) & ((F.count(v) == rows) | (F.count(v) == 0)),
            "parsed": F.count(to_time(v)) if c in text else F.lit(0).cast("bigint"),
            **clean.fingerprint_measures(v),
        }

    facts = column_facts(df, names, measures, buffers=10)
    log.columns("title_case", "changed", {c: f["changed"] for c, f in facts.items() if f["changed"]})
    keep = {c: value[c] for c in df.columns}
    if o.drop_constant:
        dropped = [c for c in names if facts[c]["same"]]
        log.columns("drop_constant", "dropped", dict.fromkeys(dropped, 1))
        keep = {c: v for c, v in keep.items() if c not in dropped}
    if o.drop_duplicate_columns:
        same = clean.equal_pairs(df, {c: facts[c] for c in names if c in keep}, value)
        log.columns("drop_duplicate_columns", "dropped", dict.fromkeys(same, 1))
        keep = {c: v for c, v in keep.items() if c not in same}
    missing = {c: facts[c]["missing"] for c in names}
    if o.bool_to_int:
        flags = [c for c in columns_of(df, BOOLEAN) if c in keep]
        keep |= {c: keep[c].cast("int") for c in flags}
        log.columns("bool_to_int", "converted", dict.fromkeys(flags, 1))
    if o.convert_dates:
        dates = [c for c in text if c in keep and 0 < facts[c]["parsed"] >= o.date_share * facts[c]["rows"]]
        log.columns("convert_dates", "unparsable", {c: facts[c]["rows"] - missing[c] - facts[c]["parsed"] for c in dates})
        keep |= {c: to_time(keep[c]) for c in dates}
        missing |= {c: facts[c]["rows"] - facts[c]["parsed"] for c in dates}
    if o.drop_sparse:
        sparse = [c for c in names if c in keep and missing[c] >= o.sparse_share * facts[c]["rows"] > 0]
        log.columns("drop_sparse", "dropped", dict.fromkeys(sparse, 1))
        keep = {c: v for c, v in keep.items() if c not in sparse}
    return df.select(*[v.alias(c) for c, v in keep.items()])


def clean_basic(df: DataFrame, options: BasicCleanOptions = BasicCleanOptions()) -> Cleaned:
    """The shorter run: duplicates, constant and identifier columns, dates, fills."""
    o, log = options, _Log()
    df = nan_to_null(df)
    rows_before, columns_before = df.count(), len(df.columns)
    with _deduped(df, o.drop_duplicates) as (df, written):
        df, rows = _basic_steps(df, rows_before, o, log)
    log.add("total", "rows_before", rows_before)
    log.add("total", "rows_after", rows)
    log.add("total", "columns_before", columns_before)
    log.add("total", "columns_after", len(df.columns))
    return Cleaned(df, list(log), written)


def _basic_steps(df, rows, o, log):
    if o.drop_duplicates:
        rows_before, rows = rows, df.count()
        log.add("duplicates", "removed_rows", rows_before - rows)
    if o.drop_constant:
        dropped = constant_names(df)
        df = df.drop(*dropped)
        log.columns("drop_constant", "dropped", dict.fromkeys(dropped, 1))
    if o.drop_identifiers:
        dropped = identifier_names(df, o.profile)
        df = df.drop(*dropped)
        log.columns("drop_identifiers", "dropped", dict.fromkeys(dropped, 1))
    if o.convert_dates:
        dates = clean.find_date_text(df, o.date_share)
        df = replace_columns(df, {c: to_time(col(c)) for c in dates})
        log.columns("convert_dates", "converted", dict.fromkeys(dates, 1))
    missing = clean.missing_counts(df, columns_of(df, NUMERIC, TEXT))
    fills = clean.find_numeric_fills(df, o.numeric_fill, missing=missing)
    df = clean.apply_fills(df, fills)
    log.columns("fill_numeric", "filled", {c: missing[c] for c in fills})
    if o.text_fill == "drop":
        text = columns_of(df, TEXT)
        df = df.na.drop(subset=text)
        left = df.count()
        log.add("fill_text", "dropped_rows", rows - left)
        rows = left
    else:
        fills = clean.find_text_fills(df, o.text_fill, o.fill_constant, missing)
        df = replace_columns(df, {c: F.coalesce(col(c), F.lit(v)) for c, v in fills.items()})
        log.columns("fill_text", "filled", {c: missing[c] for c in fills})
    return df, rows
