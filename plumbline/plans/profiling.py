"""Registered profiling queries and their checking SQL."""

from __future__ import annotations

from plumbline.operators import profile, roles
from plumbline.plans.fixtures import Catalog, Query, cte, table

ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string", "const_region": "string",
    "custkey_copy": "bigint", "empty_col": "string", "sparse_status": "string", "cents_text": "string",
    "date_text": "string", "is_even": "boolean",
}
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
NUMBERS = ("bigint", "int", "double")


def numeric(columns: dict[str, str]) -> list[str]:
    return [c for c, t in columns.items() if t in NUMBERS]


def text(columns: dict[str, str]) -> list[str]:
    return [c for c, t in columns.items() if t in ("string", "boolean")]


def each(columns, template) -> str:
    """``template(column)`` for every column, glued with UNION ALL."""
    return " UNION ALL ".join(template(c) for c in columns)


def pct(part: str, whole: str) -> str:
    return f"round(coalesce(({part}) * 100e0 / nullif({whole}, 0), 0), 2)"


def bytes_sql(c: str, t: str) -> str:
    if t == "string":
        return f"CAST(coalesce(sum(strlen({c})), 0) AS BIGINT)"
    return f"CAST(count(*) * {dict(boolean=1, int=4).get(t, 8)} AS BIGINT)"


def top_sql(c: str, source: str) -> str:
    return f"(SELECT {c} v, count(*) n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"


def quartiles_sql(c: str, source: str) -> str:
    return (
        f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) med, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) q3 FROM {source})"
    )


def outlier_count_sql(c: str, source: str) -> str:
    return (
        f"(SELECT count(*) FROM {source} s, {quartiles_sql(c, source)} q "
        f"WHERE s.{c} < q1 - 1.5e0 * (q3 - q1) OR s.{c} > q3 + 1.5e0 * (q3 - q1))"
    )


def column_profile_sql(columns: dict[str, str], source: str) -> str:
    def one(c):
        t = columns[c]
        num = t in NUMBERS
        x = f"CAST({c} AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        top = f"(SELECT CAST(v AS VARCHAR) FROM {top_sql(c, source)})" if not num else "CAST(NULL AS VARCHAR)"
        top_n = f"(SELECT coalesce(max(n), 0) FROM {top_sql(c, source)})" if not num else "CAST(NULL AS BIGINT)"
        return f"""
        SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing,
          {pct(f"count(*) - count({c})", "count(*)")} AS missing_pct, count(DISTINCT {c}) AS "distinct",
          CAST(min({c}) AS VARCHAR) AS sample_value, {bytes_sql(c, t)} AS bytes,
          count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END <= 1 AS is_constant,
          count(DISTINCT {c}) = count(*) AS is_identifier,
          round(min({x}), 4) AS "min", round(max({x}), 4) AS "max", round(avg({x}), 4) AS mean,
          round(quantile_cont({x}, 0.5), 4) AS median, round(stddev_samp({x}), 4) AS std,
          {f"CAST({outlier_count_sql(c, source)} AS BIGINT)" if num else "CAST(NULL AS BIGINT)"} AS outliers,
          {top} AS top_value, {top_n} AS top_count
        FROM {source}"""

    return each(columns, one)


# Whole-table facts of dirty_orders, the base of the scores and rules.
_nulls = " + ".join(f"(count(*) - count({c}))" for c in ORDERS)
_constants = " + ".join(
    f"CASE WHEN count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END <= 1 THEN 1 ELSE 0 END"
    for c in ORDERS
)
_empty = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in ORDERS)
_identifiers = " + ".join(
    f"CASE WHEN count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END > 0.98e0 * count(*) "
    "THEN 1 ELSE 0 END"
    for c in ORDERS
)
_bytes = " + ".join(bytes_sql(c, t) for c, t in ORDERS.items())
FACTS = f"""{cte("dirty_orders")},
facts AS (
  SELECT count(*) AS "rows", CAST(13 AS BIGINT) AS columns, CAST({_nulls} AS BIGINT) AS missing_cells,
    {pct(_nulls, "count(*) * 13")} AS missing_pct,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS BIGINT) AS duplicate_rows,
    {pct("count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders))", "count(*)")} AS duplicate_pct,
    CAST({_empty} AS BIGINT) AS empty_columns, CAST({_constants} AS BIGINT) AS constant_columns,
    CAST({_identifiers} AS BIGINT) AS identifier_columns,
    CAST(4 AS BIGINT) AS numeric_columns, CAST(7 AS BIGINT) AS text_columns,
    CAST(1 AS BIGINT) AS boolean_columns, CAST(1 AS BIGINT) AS datetime_columns,
    CAST({_bytes} AS BIGINT) AS storage_bytes
  FROM dirty_orders),
health AS (
  SELECT round(least(greatest(100e0 - (least(missing_pct * 0.35e0, 30) + least(duplicate_pct * 0.5e0, 20)
    + constant_columns * 2 + identifier_columns), 0), 100), 2) AS health_score FROM facts)
"""


def _orders(f):
    return lambda spark, sf: f(table(spark, sf, "dirty_orders"))


def _facts(f):
    return lambda spark, sf: f(profile.dataset_facts(table(spark, sf, "dirty_orders")))


def _lineitem(f):
    return lambda spark, sf: f(table(spark, sf, "lineitem"))


def _correlations_sql(columns, source, digits):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {digits}) AS r "
        f"FROM {source}"
        for a, b in pairs
    )


_IDENTIFIERS_SQL = f"""{cte("dirty_orders")}, r AS ({each(ORDERS, lambda c: f'''
  SELECT '{c}' AS "column", (count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END) * 1e0 / count(*) AS share
  FROM dirty_orders''')})
SELECT "column", 'distinct' AS reason, round(share * 100, 2) AS distinct_pct FROM r WHERE share > 0.98e0"""

_DATE_LIKE = "regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"


def _parsed(c):
    return f"count({c})" if ORDERS[c] == "timestamp_ntz" else f"count(CASE WHEN {_DATE_LIKE.format(c=c)} THEN 1 END)"


_DATES = [c for c, t in ORDERS.items() if t in ("string", "timestamp_ntz")]


def _outliers_sql(columns, source):
    return each(
        numeric(columns),
        lambda c: f"""
        SELECT '{c}' AS "column", count({c}) AS "values", CAST({outlier_count_sql(c, source)} AS BIGINT) AS outliers,
          {pct(outlier_count_sql(c, source), f"count({c})")} AS outlier_pct,
          round(any_value(q1 - 1.5e0 * (q3 - q1)), 4) AS lower_fence, round(any_value(q3 + 1.5e0 * (q3 - q1)), 4) AS upper_fence
        FROM {source}, {quartiles_sql(c, source)} q""",
    )


_LINE_NULLS = " + ".join(f"(count(*) - count({c}))" for c in LINEITEM)
_LINE_BYTES = " + ".join(bytes_sql(c, t) for c, t in LINEITEM.items())
_LINE_COPIES = "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))"

_STATS_SQL = each(
    numeric(LINEITEM),
    lambda c: f"""
    SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing,
      round(avg({c}), 4) AS mean, round(any_value(q.med), 4) AS median, round(stddev_samp({c}), 4) AS std,
      round(var_samp({c}), 4) AS variance, round(min(CAST({c} AS DOUBLE)), 4) AS "min",
      round(max(CAST({c} AS DOUBLE)), 4) AS "max", round(any_value(q.q1), 4) AS q1, round(any_value(q.q3), 4) AS q3
    FROM lineitem, {quartiles_sql(c, "lineitem")} q""",
)

# Columns of reports that are empty because the table lacks the kind of column they are about.
_REPORTS = {
    "numeric_stats": {"column": "VARCHAR", "count": "BIGINT", "missing": "BIGINT"}
    | dict.fromkeys(("mean", "median", "std", "variance", "min", "max", "q1", "q3"), "DOUBLE"),
    "iqr_outliers": {"column": "VARCHAR", "values": "BIGINT", "outliers": "BIGINT"}
    | dict.fromkeys(("outlier_pct", "lower_fence", "upper_fence"), "DOUBLE"),
    "categorical_stats": {"column": "VARCHAR", "count": "BIGINT", "missing": "BIGINT", "distinct": "BIGINT", "mode": "VARCHAR", "mode_count": "BIGINT"},
    "datetime_columns": {"column": "VARCHAR", "parsed": "BIGINT", "date_share": "DOUBLE"},
}


def _no_rows(report):
    return "SELECT " + ", ".join(f'CAST(NULL AS {t}) AS "{c}"' for c, t in _REPORTS[report].items()) + " WHERE 1 = 0"


def _named(name, f):
    return lambda spark, sf: f(table(spark, sf, name))


CATALOG: Catalog = {
    "column_profile": Query(
        _orders(profile.column_profile), cte("dirty_orders") + column_profile_sql(ORDERS, "dirty_orders")
    ),
    "column_profile_lineitem": Query(_lineitem(profile.column_profile), column_profile_sql(LINEITEM, "lineitem")),
    "dataset_summary": Query(
        _orders(profile.dataset_summary),
        FACTS + """SELECT "rows", columns, missing_cells, missing_pct, duplicate_rows, numeric_columns, text_columns,
          boolean_columns, datetime_columns, storage_bytes FROM facts""",
    ),
    "dataset_summary_lineitem": Query(
        _lineitem(profile.dataset_summary),
        f"""SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS columns, CAST({_LINE_NULLS} AS BIGINT) AS missing_cells,
          {pct(_LINE_NULLS, "count(*) * 11")} AS missing_pct, CAST({_LINE_COPIES} AS BIGINT) AS duplicate_rows,
          CAST(8 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS text_columns, CAST(0 AS BIGINT) AS boolean_columns,
          CAST(1 AS BIGINT) AS datetime_columns, CAST({_LINE_BYTES} AS BIGINT) AS storage_bytes FROM lineitem""",
    ),
    "duplicate_analysis_lineitem": Query(
        _lineitem(profile.duplicate_analysis),
        f"""SELECT CAST({_LINE_COPIES} AS BIGINT) AS duplicate_rows, {pct(_LINE_COPIES, "count(*)")} AS duplicate_pct,
          {_LINE_COPIES} > 0 AS has_duplicates FROM lineitem""",
    ),
    "missing_analysis": Query(
        _orders(profile.missing_analysis),
        f"""{cte("dirty_orders")}, m AS ({each(ORDERS, lambda c: f'''
          SELECT '{c}' AS "column", count(*) - count({c}) AS missing, {pct(f"count(*) - count({c})", "count(*)")} AS missing_pct,
          '{dict(string="mode", boolean="mode", timestamp_ntz="drop rows").get(ORDERS[c], "median")}' AS suggested_fill
          FROM dirty_orders''')})
        SELECT *, CASE WHEN missing_pct >= 50 THEN 'high' WHEN missing_pct >= 20 THEN 'medium' ELSE 'low' END AS severity
        FROM m WHERE missing > 0""",
    ),
    "quality_counts": Query(
        _orders(profile.quality_counts),
        FACTS + "SELECT empty_columns, constant_columns, duplicate_rows, missing_cells FROM facts",
    ),
    "health_score_counts": Query(
        _facts(profile.health_by_count),
        FACTS + """SELECT round(greatest(100e0 - (least(missing_cells * 0.05e0, 30) + least(duplicate_rows * 2, 20)
          + empty_columns * 10 + constant_columns * 5), 0), 2) AS health_score FROM facts""",
    ),
    "health_score": Query(
        _facts(profile.health_by_share),
        FACTS + """SELECT health_score, CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 80 THEN 'B'
          WHEN health_score >= 70 THEN 'C' WHEN health_score >= 60 THEN 'D' ELSE 'F' END AS grade,
          CASE WHEN health_score >= 90 THEN 'very good' WHEN health_score >= 80 THEN 'good'
          WHEN health_score >= 70 THEN 'fair' WHEN health_score >= 60 THEN 'weak' ELSE 'poor' END AS label FROM health""",
    ),
    "readiness": Query(
        _facts(profile.readiness),
        FACTS + """SELECT health_score, CASE WHEN health_score >= 90 THEN 'ready' WHEN health_score >= 75 THEN 'nearly ready'
          WHEN health_score >= 60 THEN 'needs cleaning' ELSE 'not ready' END AS readiness FROM health""",
    ),
    "identifier_columns": Query(_orders(roles.identifier_columns), _IDENTIFIERS_SQL),
    "constant_columns": Query(
        _orders(roles.constant_columns),
        f"""{cte("dirty_orders")}, r AS ({each(ORDERS, lambda c: f'''
          SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS d
          FROM dirty_orders''')})
        SELECT "column", "rows", missing FROM r WHERE d + CASE WHEN missing > 0 THEN 1 ELSE 0 END <= 1""",
    ),
    "datetime_columns": Query(
        _orders(roles.datetime_columns),
        f"""{cte("dirty_orders")}, r AS ({each(_DATES, lambda c: f'''
          SELECT '{c}' AS "column", {_parsed(c)} AS parsed, count(*) AS n FROM dirty_orders''')})
        SELECT "column", parsed, round(parsed * 1e0 / n, 4) AS date_share FROM r WHERE parsed >= 0.8e0 * n""",
    ),
    "feature_types": Query(
        _orders(roles.feature_types),
        f"""{cte("dirty_orders")}, r AS ({each(ORDERS, lambda c: f'''
          SELECT '{c}' AS "column", '{ORDERS[c]}' AS dtype, count(DISTINCT {c}) AS "distinct",
          {f"{_parsed(c)} >= 0.8e0 * count(*)" if c in _DATES else "false"} AS is_date FROM dirty_orders''')})
        SELECT "column", dtype, CASE WHEN is_date THEN 'datetime' WHEN dtype IN ('bigint', 'double') THEN 'numeric'
          WHEN dtype = 'boolean' THEN 'boolean' WHEN "distinct" > 50 THEN 'text' ELSE 'categorical' END AS role, "distinct"
        FROM r""",
    ),
    "categorical_columns": Query(
        _orders(roles.categorical_columns),
        f"""{cte("dirty_orders")}, r AS ({each([c for c in ORDERS if c != "o_orderdate"], lambda c: f'''
          SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct",
          {"least(20, greatest(5, floor(count(*) * 0.05e0)))" if ORDERS[c] in NUMBERS else "1e18"} AS top
          FROM dirty_orders''')})
        SELECT "column", "distinct" FROM r WHERE "distinct" >= 2 AND "distinct" <= top""",
    ),
    "numeric_stats": Query(_lineitem(profile.numeric_stats), _STATS_SQL),
    # the same by selection, which otherwise starts at 250,000 values a column
    "numeric_stats_selected": Query(_lineitem(lambda df: profile.numeric_stats(df, in_memory=0)), _STATS_SQL),
    "numeric_stats_text_table": Query(_named("conversations", lambda df: profile.numeric_stats(df.select("role", "text"))), _no_rows("numeric_stats")),
    "iqr_outliers_text_table": Query(_named("region", lambda df: profile.iqr_outliers(df.select("r_name"))), _no_rows("iqr_outliers")),
    "categorical_stats_number_table": Query(_named("embeddings", profile.categorical_stats), _no_rows("categorical_stats")),
    "datetime_columns_number_table": Query(_named("embeddings", roles.datetime_columns), _no_rows("datetime_columns")),
    "feature_types_embeddings": Query(
        _named("embeddings", roles.feature_types),
        """SELECT 'vec_id' AS "column", 'bigint' AS dtype, 'numeric' AS role, count(DISTINCT vec_id) AS "distinct" FROM embeddings
        UNION ALL SELECT 'label', 'int', 'numeric', count(DISTINCT label) FROM embeddings
        UNION ALL SELECT 'embedding', 'array<float>', CASE WHEN count(DISTINCT embedding) > 50 THEN 'text' ELSE 'categorical' END,
          count(DISTINCT embedding) FROM embeddings""",
    ),
    "feature_types_conversations": Query(
        _named("conversations", roles.feature_types),
        each(
            {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}.items(),
            lambda c: f"""SELECT '{c[0]}' AS "column", '{c[1]}' AS dtype, CASE WHEN '{c[1]}' = 'bigint' THEN 'numeric'
              WHEN count(DISTINCT {c[0]}) > 50 THEN 'text' ELSE 'categorical' END AS role, count(DISTINCT {c[0]}) AS "distinct"
            FROM conversations""",
        ),
    ),
    "categorical_stats": Query(
        _orders(profile.categorical_stats),
        cte("dirty_orders")
        + each(
            text(ORDERS),
            lambda c: f"""
            SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct",
              (SELECT CAST(v AS VARCHAR) FROM {top_sql(c, "dirty_orders")}) AS mode,
              (SELECT coalesce(max(n), 0) FROM {top_sql(c, "dirty_orders")}) AS mode_count
            FROM dirty_orders""",
        ),
    ),
    "categorical_stats_documents": Query(
        _named("documents", profile.categorical_stats),
        each(
            ("text", "lang", "source"),
            lambda c: f"""
            SELECT '{c}' AS "column", count({c}) AS "count", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct",
              (SELECT CAST(v AS VARCHAR) FROM {top_sql(c, "documents")}) AS mode,
              (SELECT coalesce(max(n), 0) FROM {top_sql(c, "documents")}) AS mode_count
            FROM documents""",
        ),
    ),
    "iqr_outliers": Query(_orders(profile.iqr_outliers), cte("dirty_orders") + _outliers_sql(ORDERS, "dirty_orders")),
    "iqr_outliers_lineitem": Query(_lineitem(profile.iqr_outliers), _outliers_sql(LINEITEM, "lineitem")),
    "duplicate_analysis": Query(
        _orders(profile.duplicate_analysis),
        FACTS + "SELECT duplicate_rows, duplicate_pct, duplicate_rows > 0 AS has_duplicates FROM facts",
    ),
    "storage_estimate": Query(
        _orders(profile.storage_estimate),
        f"""{cte("dirty_orders")}, r AS ({each(ORDERS, lambda c: f'''
          SELECT '{c}' AS "column", '{ORDERS[c]}' AS t, {bytes_sql(c, ORDERS[c])} AS bytes,
            count(DISTINCT {c}) * 1e0 / count(*) AS share FROM dirty_orders''')})
        SELECT "column", bytes, round(bytes * CASE WHEN t IN ('bigint', 'double') THEN 0.35e0
          WHEN t = 'string' AND share < 0.4e0 THEN 0.6e0 ELSE 0e0 END, 2) AS possible_saving FROM r""",
    ),
    "correlation_matrix": Query(
        _lineitem(profile.correlation_matrix),
        f"""WITH c AS ({_correlations_sql(numeric(LINEITEM), "lineitem", 4)})
        SELECT *, row_number() OVER (ORDER BY abs(r) DESC, column_a, column_b) AS "rank",
          row_number() OVER (ORDER BY r DESC, column_a, column_b) AS signed_rank FROM c WHERE r IS NOT NULL""",
    ),
    "strong_correlations": Query(
        _orders(profile.strong_correlations),
        f"{cte('dirty_orders')}, c AS ({_correlations_sql(numeric(ORDERS), 'dirty_orders', 3)}) SELECT * FROM c WHERE abs(r) >= 0.7e0",
    ),
}
