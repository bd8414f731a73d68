"""Registered cleaning queries and their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import CLEAN_TOKENS, LOAD_TOKENS, NUMBER_PATTERN, CleanOptions
from plumbline.functions.schema import col
from plumbline.operators import clean, clean_runs
from plumbline.plans.fixtures import Catalog, Query, cte, table
from plumbline.plans.profiling import ORDERS, quartiles_sql, top_sql
from plumbline.sources import io

# Words for whole-number quantities in the given tables.
QUANTITIES = ("count",)
EVENTS = ("event_id", "user_id", "ts", "event_type", "value", "visits_count", "price_text")
ORDERS_TEXT = [c for c, t in ORDERS.items() if t == "string"]

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NUMBER = NUMBER_PATTERN.replace(r"\s*", "")


def trim_sql(c):
    return f"trim({c}, {_WS})"


def tokens_sql(tokens):
    return "(" + ", ".join(f"'{t}'" for t in tokens) + ")"


def strip_sql(c):
    tail = rf"regexp_replace({trim_sql(c)}, '[^\p{{L}}\p{{N}}]+$', '')"
    return rf"regexp_replace({tail}, '^[^\p{{L}}\p{{N}}]*?([+-]?[.]?\p{{N}}|\p{{L}})', '\1')"


def clean_text_sql(c, tokens=CLEAN_TOKENS):
    return f"CASE WHEN {strip_sql(c)} NOT IN {tokens_sql(tokens)} THEN {strip_sql(c)} END"


def number_sql(c):
    return f"CASE WHEN regexp_matches({trim_sql(c)}, '{_NUMBER}') THEN CAST({trim_sql(c)} AS DOUBLE) END"


def date_sql(c):
    return rf"CASE WHEN regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN CAST({c} AS TIMESTAMP) END"


def title_sql(c):
    runs = rf"regexp_extract_all({c}, '(\p{{L}}+|[^\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '')"


def select(columns, new, source, rest=""):
    """SELECT of all columns, some replaced; ``None`` drops a column."""
    items = [f"{new[c]} AS {c}" if c in new else c for c in columns if new.get(c, c) is not None]
    return f"SELECT {', '.join(items)} FROM {source} {rest}"


def median_sql(c, source):
    return f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {source})"


def mode_sql(c, source):
    return f"(SELECT v FROM {top_sql(c, source)})"


def capped_sql(c, source):
    low = f"(SELECT q1 - 1.5e0 * (q3 - q1) FROM {quartiles_sql(c, source)})"
    high = f"(SELECT q3 + 1.5e0 * (q3 - q1) FROM {quartiles_sql(c, source)})"
    return f"CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END"


def _orders(f):
    return lambda spark, sf: f(table(spark, sf, "dirty_orders"))


def _events(f):
    return lambda spark, sf: f(table(spark, sf, "dirty_events"))


_O, _E = cte("dirty_orders"), cte("dirty_events")

# The full run on dirty_orders, step by step.
_FULL = f"""{_O},
texts AS ({select(ORDERS, {c: clean_text_sql(c) for c in ORDERS_TEXT}, "dirty_orders")}),
numbers AS ({select(ORDERS, {"cents_text": number_sql("cents_text")}, "texts")}),
deduped AS (SELECT DISTINCT * FROM numbers),
fills AS ({select(ORDERS, {c: f"coalesce({c}, {median_sql(c, 'deduped')})" for c in ("o_totalprice", "cents_text")}, "deduped")}),
caps AS ({select(ORDERS, {c: capped_sql(c, "fills") for c in ("o_totalprice", "cents_text")}, "fills")}),
worded AS ({select(ORDERS, {c: f"coalesce({c}, {mode_sql(c, 'caps')}, 'Unknown')" for c in ORDERS_TEXT if c != "cents_text"}, "caps")}),
titled AS ({select(ORDERS, {c: title_sql(c) for c in ORDERS_TEXT if c != "cents_text"}, "worded")}),
settled AS ({select(ORDERS, {"const_region": None, "empty_col": None, "custkey_copy": None,
    "is_even": "CAST(is_even AS INTEGER)", "cents_text": "CAST(cents_text AS BIGINT)", "date_text": date_sql("date_text")}, "titled")})
"""

_EVENTS_FULL = f"""{_E},
texts AS ({select(EVENTS, {c: clean_text_sql(c) for c in ("event_type", "price_text")}, "dirty_events")}),
numbers AS ({select(EVENTS, {"value": "CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END",
    "visits_count": "CASE WHEN visits_count - floor(visits_count) <= 1e-8 THEN visits_count END"}, "texts")}),
deduped AS (SELECT DISTINCT * FROM numbers
  WHERE coalesce(CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), CAST(ts AS VARCHAR), event_type, CAST(value AS VARCHAR),
    CAST(visits_count AS VARCHAR), price_text) IS NOT NULL),
fills AS ({select(EVENTS, {"value": f"coalesce(value, {median_sql('value', 'deduped')})",
    "visits_count": f"coalesce(visits_count, {mode_sql('visits_count', 'deduped')})"}, "deduped")}),
caps AS ({select(EVENTS, {"value": capped_sql("value", "fills")}, "fills")}),
worded AS ({select(EVENTS, {"event_type": f"coalesce(event_type, {mode_sql('event_type', 'caps')})"}, "caps")})
{select(EVENTS, {"visits_count": "CAST(visits_count AS BIGINT)", "event_type": title_sql("event_type"),
    "price_text": title_sql("price_text")}, "worded")}"""


def _count(source, cond):
    return f"(SELECT count(*) FROM {source} WHERE {cond})"


def _changed(c):
    return _count("worded", f"{c} <> {title_sql(c)}")


def _report_row(step, metric, value, subject=None):
    s = f"'{subject}'" if subject else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{step}' AS step, '{metric}' AS metric, {s} AS subject, CAST({value} AS BIGINT) AS value"


def _report_sql():
    capped = {
        c: f"(SELECT count(*) FROM fills f, caps c WHERE f.o_orderkey = c.o_orderkey AND f.{c} <> c.{c})"
        for c in ("o_totalprice",)
    }
    rows = [
        _report_row("names", "renamed_columns", 0),
        _report_row("strings", "text_columns", 7),
        _report_row("numeric_strings", "unparsable", _count("texts", f"cents_text IS NOT NULL AND ({number_sql('cents_text')}) IS NULL"), "cents_text"),
        _report_row("duplicates", "removed_rows", "(SELECT count(*) FROM numbers) - (SELECT count(*) FROM deduped)"),
        *[_report_row("fill_numeric", "filled", _count("deduped", f"{c} IS NULL"), c) for c in ("o_totalprice", "cents_text")],
        *[_report_row("cap_outliers", "capped", n, c) for c, n in capped.items()],
        *[
            _report_row("fill_text", "filled", _count("deduped", f"{c} IS NULL"), c)
            for c in ("o_orderstatus", "o_orderpriority", "empty_col", "sparse_status", "date_text")
        ],
        _report_row("restore_integers", "restored", 1, "cents_text"),
        *[_report_row("title_case", "changed", _changed(c), c) for c in ("o_orderpriority", "const_region")],
        _report_row("drop_constant", "dropped", 1, "const_region"),
        _report_row("drop_constant", "dropped", 1, "empty_col"),
        _report_row("drop_duplicate_columns", "dropped", 1, "custkey_copy"),
        _report_row("bool_to_int", "converted", 1, "is_even"),
        _report_row("convert_dates", "unparsable", 0, "date_text"),
        _report_row("total", "rows_before", "(SELECT count(*) FROM dirty_orders)"),
        _report_row("total", "rows_after", "(SELECT count(*) FROM deduped)"),
        _report_row("total", "columns_before", 13),
        _report_row("total", "columns_after", 10),
    ]
    return _FULL + " UNION ALL ".join(rows)


def _report(spark, sf):
    run = clean_runs.clean_table(table(spark, sf, "dirty_orders"))
    return run.report(spark).drop("seq")


def _rename(spark, sf):
    part = table(spark, sf, "part")
    return clean.standardize_names(part.toDF(" p-partkey", "p  name ", "p_name", "__p type--x", "p size", "retail - price"))


def _money(spark, sf):
    """Price text with symbols, separators and magnitude suffixes."""
    t = table(spark, sf, "dirty_events")
    suffix = F.when(col("event_id") % 5 == 0, "K").when(col("event_id") % 7 == 0, "M").otherwise("")
    return clean.parse_currency(t.select("event_id", F.concat("price_text", suffix).alias("price_text")), ["price_text"])


CATALOG: Catalog = {
    "standardize_names": Query(
        _rename,
        """SELECT p_partkey, p_name, p_brand AS p_name_2, p_type AS p_type_x, p_size, p_retailprice AS retail_price FROM part""",
    ),
    "preview_rows": Query(
        _orders(lambda df: io.preview(df, ["o_orderkey"], 100)),
        f"{_O} SELECT {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39)*2}) AS {c}' for c in ORDERS)} "
        "FROM dirty_orders ORDER BY dirty_orders.o_orderkey LIMIT 100",
    ),
    "normalize_missing": Query(
        _orders(clean.normalize_missing),
        f"{_O} {select(ORDERS, {c: f'CASE WHEN {trim_sql(c)} NOT IN {tokens_sql(LOAD_TOKENS)} THEN {trim_sql(c)} END' for c in ORDERS_TEXT}, 'dirty_orders')}",
    ),
    "clean_strings": Query(
        lambda spark, sf: clean.clean_strings(table(spark, sf, "documents")),
        select(
            ("doc_id", "text", "lang", "source", "n_chars"),
            {c: strip_sql(c) for c in ("text", "lang", "source")},
            "documents",
        ),
    ),
    "numeric_strings": Query(
        _orders(clean.numeric_strings),
        f"{_O} {select(ORDERS, {'cents_text': number_sql('cents_text')}, 'dirty_orders')}",
    ),
    "replace_infinite": Query(
        _events(clean.replace_infinite),
        f"""{_E} {select(EVENTS, {'value': "CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value END"}, 'dirty_events')}""",
    ),
    "integer_clean": Query(
        _events(lambda df: clean.clean_integers(df, QUANTITIES)),
        f"""{_E} {select(EVENTS, {'visits_count': "CASE WHEN visits_count - floor(visits_count) <= 1e-8 THEN visits_count END"}, 'dirty_events')}""",
    ),
    "integer_restore": Query(
        _events(lambda df: clean.restore_integers(clean.clean_integers(df, QUANTITIES), QUANTITIES)),
        f"""{_E} {select(EVENTS, {'visits_count': "CASE WHEN visits_count - floor(visits_count) <= 1e-8 THEN CAST(visits_count AS BIGINT) END"}, 'dirty_events')}""",
    ),
    "title_case": Query(
        lambda spark, sf: clean.title_case_text(table(spark, sf, "documents"), ["text", "source"]),
        select(("doc_id", "text", "lang", "source", "n_chars"), {c: title_sql(c) for c in ("text", "source")}, "documents"),
    ),
    "bool_to_int": Query(
        _orders(clean.bools_to_ints), f"{_O} {select(ORDERS, {'is_even': 'CAST(is_even AS INTEGER)'}, 'dirty_orders')}"
    ),
    "convert_dates": Query(
        _orders(clean.convert_dates), f"{_O} {select(ORDERS, {'date_text': date_sql('date_text')}, 'dirty_orders')}"
    ),
    "currency_parse": Query(
        _money,
        f"""{_E} SELECT event_id, CASE WHEN event_id IS NOT NULL THEN CAST(event_id % 1000 AS DOUBLE) * 1000
          * CASE WHEN event_id % 5 = 0 THEN 1e3 WHEN event_id % 7 = 0 THEN 1e6 ELSE 1e0 END END AS price_text FROM dirty_events""",
    ),
    "ml_coerce": Query(
        lambda spark, sf: clean.coerce_numeric(
            clean.parse_currency(table(spark, sf, "dirty_events"), ["price_text"]).select("event_id", "event_type", "value", "price_text"),
            ["event_type", "value", "price_text"],
        ),
        f"""{_E} SELECT event_id, CASE WHEN 1 = 1 THEN 0e0 END AS event_type,
          CASE WHEN abs(value) < CAST('Infinity' AS DOUBLE) THEN value ELSE 0 END AS value,
          coalesce(CAST(event_id % 1000 AS DOUBLE) * 1000, 0) AS price_text FROM dirty_events""",
    ),
    "epoch_feature": Query(
        lambda spark, sf: clean.epoch_features(table(spark, sf, "events").select("event_id", "ts")),
        "SELECT event_id, epoch_us(ts) AS ts FROM events",
    ),
    "dedupe": Query(_orders(clean.dedupe), f"{_O} SELECT DISTINCT * FROM dirty_orders"),
    "fill_categorical": Query(
        _orders(clean.fill_text),
        f"""{_O} {select(ORDERS, {c: f"coalesce({c}, {mode_sql(c, 'dirty_orders')}, 'Unknown')" for c in ORDERS_TEXT}, 'dirty_orders')}""",
    ),
    "cap_outliers": Query(
        _orders(clean.cap_outliers),
        f"{_O} {select(ORDERS, {'o_totalprice': capped_sql('o_totalprice', 'dirty_orders')}, 'dirty_orders')}",
    ),
    "outlier_rows": Query(
        _orders(lambda df: clean.outlier_rows(df, "o_totalprice")),
        f"""{_O} SELECT d.* FROM dirty_orders d, {quartiles_sql("o_totalprice", "dirty_orders")} q
          WHERE o_totalprice < q1 - 1.5e0 * (q3 - q1) OR o_totalprice > q3 + 1.5e0 * (q3 - q1)""",
    ),
    "drop_empty_rows": Query(
        _events(clean.drop_empty_rows),
        f"""{_E} SELECT * FROM dirty_events WHERE NOT (event_id IS NULL AND user_id IS NULL AND ts IS NULL AND event_type IS NULL
          AND value IS NULL AND visits_count IS NULL AND price_text IS NULL)""",
    ),
    "drop_missing_rows": Query(
        _orders(lambda df: clean.drop_missing_rows(df, ["o_orderstatus", "o_totalprice"])),
        f"{_O} SELECT * FROM dirty_orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL",
    ),
    "drop_constant_columns": Query(
        _orders(clean.drop_constant_columns), f"{_O} SELECT * EXCLUDE (const_region, empty_col) FROM dirty_orders"
    ),
    "drop_identifier_columns": Query(
        lambda spark, sf: clean.drop_identifier_columns(table(spark, sf, "events")),
        "SELECT * EXCLUDE (event_id, user_id, ts) FROM events",
    ),
    "drop_high_missing": Query(
        _orders(clean.drop_sparse_columns), f"{_O} SELECT * EXCLUDE (empty_col, sparse_status) FROM dirty_orders"
    ),
    "clean_full": Query(
        _orders(lambda df: clean_runs.clean_table(df, CleanOptions()).frame), _FULL + "SELECT * FROM settled"
    ),
    "clean_full_events": Query(
        _events(lambda df: clean_runs.clean_table(df, CleanOptions(integer_words=QUANTITIES)).frame), _EVENTS_FULL
    ),
    "clean_basic": Query(
        _orders(lambda df: clean_runs.clean_basic(df).frame),
        f"""{_O}, d AS (SELECT DISTINCT * FROM dirty_orders)
        {select(ORDERS, {"const_region": None, "empty_col": None, "date_text": date_sql("date_text"),
          "o_totalprice": f"coalesce(o_totalprice, {median_sql('o_totalprice', 'd')})",
          **{c: f"coalesce({c}, {mode_sql(c, 'd')})" for c in ("o_orderstatus", "sparse_status")}}, "d")}""",
    ),
    "cleaning_report": Query(_report, _report_sql()),
}
