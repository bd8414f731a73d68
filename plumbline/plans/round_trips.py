"""Registered queries for sources, sinks, names and fill options, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import CLEAN_TOKENS, LOAD_TOKENS
from plumbline.functions.schema import col
from plumbline.operators import charts, clean, clean_runs
from plumbline.plans.cleaning import ORDERS_TEXT, QUANTITIES, _report, _report_sql, median_sql, mode_sql, select, tokens_sql, trim_sql
from plumbline.plans.fixtures import Catalog, Query, cte, table
from plumbline.plans.profiling import ORDERS
from plumbline.session import scratch_path
from plumbline.sources import io

_O, _E = cte("dirty_orders"), cte("dirty_events")

NOTES = """SELECT o_orderkey, concat('say "', o_orderpriority, '", ', o_orderstatus) AS note,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 2 = 0 AS is_even,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat(' ', o_orderstatus) END AS gap FROM orders"""


def _orders(f):
    return lambda spark, sf: f(table(spark, sf, "dirty_orders"))


def _round_trip(fmt):
    """A table with quotes, commas and gaps, written and read again."""

    def run(spark, sf):
        table(spark, sf, "orders").createOrReplaceTempView("orders")
        return io.load(spark, io.save_table(spark.sql(NOTES), scratch_path(spark, "sink"), "notes", fmt))

    return run


def _documents_trip(spark, sf):
    """Texts with line breaks in quoted cells, written as CSV and read again from every split."""
    return io.load(spark, io.save_table(table(spark, sf, "documents"), scratch_path(spark, "sink"), "documents", "csv"))


# Identifiers of 19 digits, amounts and numbers beyond a double, codes that start with zeros.
LONG_IDS = """SELECT concat('12345678901', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS id,
  concat('9', lpad(CAST(o_orderkey AS STRING), 24, '0')) AS wide,
  concat('12345678901', lpad(CAST(o_custkey AS STRING), 8, '0'), '.', CAST(10 + o_orderkey % 90 AS STRING)) AS amount,
  lpad(CAST(o_custkey % 1000 AS STRING), 4, '0') AS code, CAST(o_orderkey % 7 AS STRING) AS small,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('note', chr(10), o_orderpriority) ELSE 'N/A' END AS note FROM orders"""


def _long_ids(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    df = io.load(spark, io.save_table(spark.sql(LONG_IDS), scratch_path(spark, "sink"), "ids", "csv"))
    types = [F.lit(t).alias(f"{c}_type") for c, t in df.dtypes]
    return df.withColumns({c: col(c).cast("string") for c in ("wide", "amount")}).select("*", *types)


def _report_trip(spark, sf):
    report = _report(spark, sf)
    path = io.save_report(report, scratch_path(spark, "report"))
    return spark.read.schema(report.schema).json(path)


def _named_columns(spark, sf):
    """Header names with blanks around them, trimmed; then one column dropped by name."""
    df = table(spark, sf, "nation").toDF(" n_nationkey", "n_name ", "\tn_regionkey ")
    return clean.drop_named(clean.trim_names(df), ["n_regionkey", "no such column"])


def _equal_sql(columns, source):
    """Pairs of columns of one type that are equal in every row, each with its first equal column."""
    names = list(columns)
    pairs = " UNION ALL ".join(
        f"""SELECT {i} AS k, '{b}' AS "column", '{a}' AS same_as FROM {source}
          HAVING count(CASE WHEN {a} IS DISTINCT FROM {b} THEN 1 END) = 0"""
        for i, a in enumerate(names)
        for b in names[i + 1 :]
        if columns[a] == columns[b]
    )
    return f'SELECT "column", arg_min(same_as, k) AS same_as FROM ({pairs}) GROUP BY 1'


def _prices(how):
    return _orders(lambda df: clean.fill_numeric(df.select("o_orderkey", "o_totalprice"), how))


def _prices_sql(value):
    return f"{_O} SELECT o_orderkey, coalesce(o_totalprice, {value}) AS o_totalprice FROM dirty_orders"


def _fill_events(spark, sf):
    """Every numeric column filled; whole-number keys as doubles, which a fractional median makes them."""
    df = clean.clean_integers(clean.replace_infinite(table(spark, sf, "dirty_events")), QUANTITIES)
    return clean.fill_numeric(df, words=QUANTITIES).withColumns({c: col(c).cast("double") for c in ("event_id", "user_id")})


_TOKENS = {c: f"CASE WHEN {c} NOT IN {tokens_sql(CLEAN_TOKENS)} THEN {c} END" for c in ORDERS_TEXT}
_CONSTANT = {c: f"coalesce({c}, 'none given')" for c in ORDERS_TEXT}
_FULL_TEXT = [c for c in ORDERS_TEXT if c != "empty_col"]

CATALOG: Catalog = {
    **{f"{fmt}_round_trip": Query(_round_trip(fmt), NOTES) for fmt in ("parquet", "orc", "json")},
    "csv_round_trip": Query(
        _round_trip("csv"),
        f"SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, note, price, is_even, trim(gap) AS gap FROM ({NOTES})",
    ),
    "csv_multiline_round_trip": Query(
        _documents_trip,
        f"""SELECT CAST(doc_id AS INTEGER) AS doc_id, CASE WHEN {trim_sql("text")} NOT IN {tokens_sql(LOAD_TOKENS)} THEN {trim_sql("text")} END AS text,
          lang, source, CAST(n_chars AS INTEGER) AS n_chars FROM documents""",
    ),
    "csv_long_ids": Query(
        _long_ids,
        f"""SELECT CAST(id AS BIGINT) AS id, wide, amount, code, CAST(small AS INTEGER) AS small, nullif(note, 'N/A') AS note,
          'bigint' AS id_type, 'decimal(38,0)' AS wide_type, 'decimal(21,2)' AS amount_type, 'string' AS code_type,
          'int' AS small_type, 'string' AS note_type FROM ({LONG_IDS})""",
    ),
    "report_round_trip": Query(_report_trip, _report_sql()),
    "trim_and_drop_names": Query(_named_columns, "SELECT n_nationkey, n_name FROM nation"),
    "null_tokens": Query(_orders(clean.null_tokens), f"{_O} {select(ORDERS, _TOKENS, 'dirty_orders')}"),
    "duplicate_columns": Query(_orders(clean.duplicate_columns), f"{_O} {_equal_sql(ORDERS, 'dirty_orders')}"),
    "fill_numeric": Query(
        _fill_events,
        f"""{_E}, f AS (SELECT event_type, price_text, ts, event_id, user_id,
            CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END AS value,
            CASE WHEN visits_count - floor(visits_count) <= 1e-8 THEN visits_count END AS visits_count FROM dirty_events)
        SELECT event_type, price_text, ts, coalesce(CAST(event_id AS DOUBLE), {median_sql("event_id", "f")}) AS event_id,
          coalesce(CAST(user_id AS DOUBLE), {median_sql("user_id", "f")}) AS user_id,
          coalesce(value, {median_sql("value", "f")}) AS value,
          coalesce(visits_count, {mode_sql("visits_count", "f")}) AS visits_count FROM f""",
    ),
    "fill_numeric_mean": Query(
        _orders(lambda df: clean.fill_numeric(df.select("o_orderkey", "o_totalprice"), "mean").withColumn("o_totalprice", F.round("o_totalprice", 4))),
        f"""{_O} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM dirty_orders)), 4) AS o_totalprice
          FROM dirty_orders""",
    ),
    "fill_numeric_median": Query(_prices("median"), _prices_sql(median_sql("o_totalprice", "dirty_orders"))),
    "fill_numeric_mode": Query(_prices("mode"), _prices_sql(mode_sql("o_totalprice", "dirty_orders"))),
    "fill_text_constant": Query(
        _orders(lambda df: clean.fill_text(df, "constant", "none given")), f"{_O} {select(ORDERS, _CONSTANT, 'dirty_orders')}"
    ),
    "fill_text_drop": Query(
        _orders(lambda df: clean.fill_text(df.drop("empty_col"), "drop")),
        f"{_O} SELECT * EXCLUDE (empty_col) FROM dirty_orders WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _FULL_TEXT),
    ),
    "pair_plot_points": Query(
        _orders(lambda df: charts.pair_plot_points(df, "o_orderkey")),
        f"""{_O} SELECT o_orderkey, o_custkey, o_totalprice, custkey_copy FROM dirty_orders
        ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 1000""",
    ),
}
