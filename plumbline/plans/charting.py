"""Registered chart-data queries and their checking SQL."""

from __future__ import annotations

from plumbline.operators import charts
from plumbline.plans.fixtures import Catalog, Query, cte, table
from plumbline.plans.profiling import LINEITEM, ORDERS, each, numeric, outlier_count_sql, quartiles_sql

_O, _S = cte("dirty_orders"), cte("scored_docs")
_PART_TEXT = ("p_name", "p_brand", "p_type")
_STATUS = ("o_orderstatus", "o_orderpriority", "sparse_status")
_PART_NUMBERS = ("p_partkey", "p_size", "p_retailprice")
_MEASURES = numeric(ORDERS)


def _on(name, f):
    return lambda spark, sf: f(table(spark, sf, name))


def counts_sql(columns, source):
    return each(
        columns,
        lambda c: f"""SELECT '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, count(*) AS n
          FROM {source} GROUP BY 2""",
    )


def topk_sql(columns, source, k):
    return f"""c AS ({counts_sql(columns, source)}),
      r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS "rank" FROM c)
      SELECT *, round(n * 100e0 / (SELECT count(*) FROM {source}), 1) AS share_pct,
        round(n * 100e0 / sum(n) OVER (PARTITION BY "column"), 1) AS share_of_kept_pct FROM r WHERE "rank" <= {k}"""


def daily_sql(date, measure, source):
    return f"""SELECT CAST({date} AS DATE) AS day, round(CAST(coalesce(sum({measure}), 0) AS DOUBLE), 2) AS total
      FROM {source} WHERE {date} IS NOT NULL GROUP BY 1"""


_DAY = {
    "o_orderdate": "CAST(o_orderdate AS DATE)",
    "date_text": "CASE WHEN regexp_matches(date_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN CAST(date_text AS DATE) END",
}


def lines_sql():
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS date_column, '{m}' AS measure, {day} AS day,
          round(CAST(coalesce(sum({m}), 0) AS DOUBLE), 2) AS total FROM dirty_orders WHERE {day} IS NOT NULL GROUP BY 3"""
        for d, day in _DAY.items()
        for m in _MEASURES
    )


def _peaks(keys):
    return f"""SELECT {keys}count(*) AS periods, round(sum(total), 2) AS total_value, round(avg(total), 2) AS mean_value,
      max(total) AS peak_value, arg_min(day, (-total, day)) AS peak_day FROM t"""


def bins_sql(columns, source, tail):
    def one(c):
        x = f"CAST({c} AS DOUBLE)"
        return f"""SELECT '{c}' AS "column", b.bin AS bin, round(lo + b.bin * w, 4) AS low, round(lo + (b.bin + 1) * w, 4) AS high,
            coalesce(k.n, 0) AS n, round(mean, 4) AS mean, round(median, 4) AS median, w, total
          FROM (SELECT min({x}) lo, (max({x}) - min({x})) / 30e0 w, avg({x}) mean, quantile_cont({x}, 0.5) median,
              count({c}) total FROM {source}) s, (SELECT CAST(range AS BIGINT) AS bin FROM range(30)) b
          LEFT JOIN (SELECT CAST(least(floor(({x} - lo) / w), 29) AS BIGINT) AS bin, count(*) AS n
            FROM {source}, (SELECT min({x}) lo, (max({x}) - min({x})) / 30e0 w FROM {source}) WHERE {c} IS NOT NULL GROUP BY 1) k
          ON k.bin = b.bin"""

    return f"WITH h AS ({each(columns, one)}) {tail}"


_WIDE = [c for c in numeric(LINEITEM) if c not in ("l_linenumber", "l_tax")]

CATALOG: Catalog = {
    "value_counts": Query(_on("part", charts.category_counts), counts_sql(_PART_TEXT, "part")),
    "topk_categories": Query(_on("part", lambda df: charts.topk_categories(df, 30)), "WITH " + topk_sql(_PART_TEXT, "part", 30)),
    "bar_topk": Query(
        _on("dirty_orders", lambda df: charts.topk_categories(df, 15, ["o_orderpriority", "date_text", "cents_text"])),
        f"{_O}, {topk_sql(('o_orderpriority', 'date_text', 'cents_text'), 'dirty_orders', 15)}",
    ),
    "category_share": Query(
        _on("dirty_orders", lambda df: charts.category_share(df, list(_STATUS))),
        f"""{_O}, c AS ({counts_sql(_STATUS, "dirty_orders")})
        SELECT *, round(n * 100e0 / (SELECT count(*) FROM dirty_orders), 1) AS share_pct,
          row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) = 1 AS is_dominant FROM c""",
    ),
    "two_level_counts": Query(
        _on("part", charts.two_level_counts),
        "SELECT p_name AS level_1, p_brand AS level_2, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200",
    ),
    "class_balance": Query(
        _on("scored_docs", lambda df: charts.class_balance(df, "quality")),
        f"""{_S} SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n, round(count(*) * 100e0 / (
          SELECT count(quality) FROM scored_docs), 2) AS share_pct FROM scored_docs WHERE quality IS NOT NULL GROUP BY 1""",
    ),
    "daily_trend": Query(
        _on("orders", lambda df: charts.daily_trend(df, "o_orderdate", "o_totalprice")),
        daily_sql("o_orderdate", "o_totalprice", "orders"),
    ),
    "daily_trend_events": Query(
        _on("events", lambda df: charts.daily_trend(df, "ts", "value")), daily_sql("ts", "value", "events")
    ),
    "trend_summary": Query(
        _on("orders", lambda df: charts.trend_summary(charts.daily_trend(df, "o_orderdate", "o_totalprice"))),
        f"WITH t AS ({daily_sql('o_orderdate', 'o_totalprice', 'orders')}) {_peaks('')}",
    ),
    "trend_lines": Query(_on("dirty_orders", charts.trend_lines), f"{_O} {lines_sql()}"),
    "trend_summaries": Query(
        _on("dirty_orders", charts.trend_summaries),
        f"{_O}, t AS ({lines_sql()}) {_peaks('date_column, measure, ')} GROUP BY 1, 2",
    ),
    "histogram": Query(
        _on("lineitem", charts.histogram_bins), bins_sql(numeric(LINEITEM), "lineitem", "SELECT * EXCLUDE (w, total) FROM h")
    ),
    "density": Query(
        _on("lineitem", charts.density),
        bins_sql(
            _WIDE,
            "lineitem",
            """SELECT "column", bin, low, high, round(n / w, 6) AS density, round(n / w / total, 9) AS probability_density FROM h""",
        ),
    ),
    "box_stats": Query(
        _on("lineitem", charts.box_stats),
        each(
            numeric(LINEITEM),
            lambda c: f"""SELECT '{c}' AS "column", round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median,
              round(any_value(q3), 4) AS q3, round(any_value(q1 - 1.5e0 * (q3 - q1)), 4) AS lower_fence,
              round(any_value(q3 + 1.5e0 * (q3 - q1)), 4) AS upper_fence,
              round(min(CASE WHEN {c} >= q1 - 1.5e0 * (q3 - q1) THEN CAST({c} AS DOUBLE) END), 4) AS whisker_low,
              round(max(CASE WHEN {c} <= q3 + 1.5e0 * (q3 - q1) THEN CAST({c} AS DOUBLE) END), 4) AS whisker_high,
              CAST({outlier_count_sql(c, "lineitem")} AS BIGINT) AS outliers
            FROM lineitem, {quartiles_sql(c, "lineitem")} q""",
        ),
    ),
    "box_points": Query(
        _on("dirty_orders", charts.box_points),
        _O
        + each(
            _MEASURES,
            lambda c: f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM dirty_orders, {quartiles_sql(c, "dirty_orders")} q
              WHERE {c} < q1 - 1.5e0 * (q3 - q1) OR {c} > q3 + 1.5e0 * (q3 - q1)""",
        ),
    ),
    "violin_stats": Query(
        _on("part", charts.violin_stats),
        each(
            _PART_NUMBERS,
            lambda c: f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(any_value(med), 4) AS median,
              round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3 FROM part, {quartiles_sql(c, "part")} q""",
        ),
    ),
    "missing_bars": Query(
        _on("dirty_events", charts.missing_bars),
        f"""{cte("dirty_events")}, m AS ({each(("event_id", "user_id", "ts", "event_type", "value", "visits_count", "price_text"),
          lambda c: f'''SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM dirty_events''')})
        SELECT * FROM m WHERE missing > 0""",
    ),
    "scatter_ols": Query(
        _on("lineitem", charts.scatter_ols),
        " UNION ALL ".join(
            f"""SELECT '{x}' AS x, '{y}' AS y, CAST(regr_count({y}, {x}) AS BIGINT) AS n, round(regr_slope({y}, {x}), 6) AS slope,
              round(regr_intercept({y}, {x}), 4) AS intercept, round(regr_r2({y}, {x}), 6) AS r2, round(corr({x}, {y}), 2) AS r
            FROM lineitem"""
            for i, x in enumerate(numeric(LINEITEM)[:5])
            for y in numeric(LINEITEM)[i + 1 : 5]
        ),
    ),
    "point_sample": Query(
        _on("orders", lambda df: charts.point_sample(df, "o_orderkey", ["o_custkey", "o_totalprice"], 1000)),
        """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 1000""",
    ),
}
