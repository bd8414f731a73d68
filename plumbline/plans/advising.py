"""Registered rule queries and their checking SQL."""

from __future__ import annotations

from plumbline.config import TargetRules, name_words
from plumbline.operators import advice, profile
from plumbline.plans.fixtures import Catalog, Query, cte, table
from plumbline.plans.profiling import CATALOG as PROFILING
from plumbline.plans.profiling import FACTS, NUMBERS, ORDERS, each

_DOCS = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


def _orders(f):
    return lambda spark, sf: f(table(spark, sf, "dirty_orders"))


def _part(key):
    """Another query's checking SQL without its shared head, as a named subquery."""
    return PROFILING[key].oracle.removeprefix(cte("dirty_orders"))


def _named(key):
    body = _part(key).lstrip()
    return f"(WITH {body[1:]})" if body.startswith(",") else f"({body})"


_RULES = [
    ("health_score >= 90", "health_good", "info", "The table is in good shape.", "0"),
    ("health_score < 90 AND health_score >= 70", "health_fair", "medium", "The table needs some cleaning.", "0"),
    ("health_score < 70", "health_poor", "high", "The table needs thorough cleaning.", "0"),
    ("missing_cells > 0", "missing_values", "medium", "Some cells have no value.", "missing_cells"),
    ("duplicate_rows > 0", "duplicate_rows", "medium", "Some rows repeat another row.", "duplicate_rows"),
    ("empty_columns > 0", "empty_columns", "high", "Some columns hold no value at all.", "empty_columns"),
    ("constant_columns > 0", "constant_columns", "low", "Some columns hold a single value.", "constant_columns"),
    ("identifier_columns > 0", "identifier_columns", "low", "Some columns only name rows.", "identifier_columns"),
    ("numeric_columns = 0", "no_numeric_columns", "medium", "There is no numeric column.", "0"),
    ("text_columns > numeric_columns", "mostly_text", "info", "Text columns outnumber numeric ones.", "text_columns"),
    ("\"rows\" < 100", "small_table", "medium", "There are few rows to learn from.", "\"rows\""),
    ("\"rows\" > 100000", "large_table", "info", "The table is large.", "\"rows\""),
]

_COUNTS = f"""{FACTS}, outl AS {_named("iqr_outliers")}, dates AS {_named("datetime_columns")}, miss AS {_named("missing_analysis")},
counts AS (SELECT f.*, (SELECT count(*) FROM outl WHERE outliers > 0) AS outlier_columns,
  (SELECT CAST(sum(outliers) AS BIGINT) FROM outl) AS outlier_values, (SELECT count(*) FROM dates) AS date_like_columns,
  (SELECT count(*) FROM miss) AS missing_columns FROM facts f)"""

_STEPS = [
    ("remove duplicate rows", "duplicate_rows"),
    ("drop constant columns", "constant_columns"),
    ("drop identifier columns", "identifier_columns"),
    ("fill missing values", "missing_cells"),
    ("cap outliers", "outlier_values"),
]
_LOG = (
    "rows", "columns", "missing_cells", "missing_columns", "duplicate_rows", "constant_columns",
    "identifier_columns", "date_like_columns", "outlier_columns",
)


# What the given tables may be asked to predict.
TARGETS = TargetRules(words=("orderstatus", "totalprice", "quality", "toxic"))


def _target_sql(columns, source):
    def one(c):
        t = columns[c]
        words = 50 * sum(w in name_words(c) for w in TARGETS.words)
        text = 30 if t == "string" else 0
        two = 0 if t == "string" else 40
        many = 20 if t in NUMBERS else 0
        return f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct", count(*) AS n,
          CAST({words} + CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 20 THEN {text} ELSE 0 END
            + CASE WHEN count(DISTINCT {c}) = 2 THEN {two} ELSE 0 END
            + CASE WHEN count(DISTINCT {c}) > 20 THEN {many} ELSE 0 END AS BIGINT) AS score FROM {source}"""

    return f"""targets AS (SELECT "column", score, "distinct",
        CASE WHEN "distinct" > 20 THEN 'regression' ELSE 'classification' END AS problem_type
      FROM ({each(columns, one)}) WHERE "distinct" < n AND score >= 30)"""


_ORDERS_SCORED = {c: t for c, t in ORDERS.items() if t != "timestamp_ntz"}

CATALOG: Catalog = {
    "findings": Query(
        _orders(lambda df: advice.findings(profile.dataset_facts(df))),
        f"""{FACTS}, f AS (SELECT facts.*, health_score FROM facts, health)
        {" UNION ALL ".join(
            f"SELECT '{code}' AS code, '{sev}' AS severity, '{msg}' AS message, CAST({n} AS BIGINT) AS affected FROM f WHERE {cond}"
            for cond, code, sev, msg, n in _RULES)}""",
    ),
    "quality_warnings": Query(
        _orders(advice.quality_warnings),
        f"""{FACTS}, outl AS {_named("iqr_outliers")}, miss AS {_named("missing_analysis")},
          cons AS {_named("constant_columns")}, ids AS {_named("identifier_columns")}
        SELECT 'duplicate_rows' AS warning, CAST(NULL AS VARCHAR) AS "column", CAST(duplicate_rows AS DOUBLE) AS value
          FROM facts WHERE duplicate_rows > 0
        UNION ALL SELECT 'mostly_missing', "column", missing_pct FROM miss WHERE severity = 'high'
        UNION ALL SELECT 'constant', "column", 1e0 FROM cons
        UNION ALL SELECT 'identifier', "column", distinct_pct FROM ids
        UNION ALL SELECT 'outliers', "column", outlier_pct FROM outl WHERE outlier_pct >= 5""",
    ),
    "cleaning_plan": Query(
        _orders(lambda df: advice.cleaning_plan(advice.table_counts(df))),
        _COUNTS
        + " UNION ALL ".join(
            f"SELECT CAST({i + 1} AS BIGINT) AS position, '{s}' AS step, {c} > 0 AS enabled, {c} AS affected FROM counts"
            for i, (s, c) in enumerate(_STEPS)
        ),
    ),
    "processing_log": Query(
        _orders(lambda df: advice.processing_log(advice.table_counts(df))),
        _COUNTS + " UNION ALL ".join(f"SELECT '{c}' AS category, \"{c}\" AS n FROM counts" for c in _LOG),
    ),
    "feature_suggestions": Query(
        _orders(advice.feature_suggestions),
        f"""{cte("dirty_orders")}, roles AS {_named("feature_types")}, ids AS {_named("identifier_columns")},
          outl AS {_named("iqr_outliers")}
        SELECT "column", CASE role WHEN 'datetime' THEN 'split into calendar parts' WHEN 'categorical' THEN 'encode as codes'
          WHEN 'text' THEN 'derive length or keywords' WHEN 'boolean' THEN 'use as 0 and 1' WHEN 'numeric' THEN 'scale' END
          AS suggestion FROM roles
        UNION ALL SELECT "column", 'leave out of models' FROM ids
        UNION ALL SELECT "column", 'cap or transform outliers' FROM outl WHERE outliers > 0""",
    ),
    "target_candidates": Query(
        _orders(lambda df: advice.target_candidates(df, TARGETS)), f"{cte('dirty_orders')}, {_target_sql(_ORDERS_SCORED, 'dirty_orders')} SELECT * FROM targets"
    ),
    "target_candidates_docs": Query(
        lambda spark, sf: advice.target_candidates(table(spark, sf, "scored_docs"), TARGETS),
        f"{cte('scored_docs')}, {_target_sql(_DOCS, 'scored_docs')} SELECT * FROM targets",
    ),
    "training_tips": Query(
        _orders(lambda df: advice.training_tips(profile.dataset_facts(df)).select("code", "affected")),
        FACTS
        + " UNION ALL ".join(
            f"SELECT '{code}' AS code, CAST({n} AS BIGINT) AS affected FROM facts WHERE {when}"
            for code, n, when in (
                ("fill_gaps", "missing_cells", "missing_cells > 0"),
                ("drop_copies", "duplicate_rows", "duplicate_rows > 0"),
                ("drop_constants", "constant_columns", "constant_columns > 0"),
                ("drop_identifiers", "identifier_columns", "identifier_columns > 0"),
                ("encode_text", "text_columns", "text_columns > 0"),
                ("cross_validate", '"rows"', '"rows" < 1000'),
                ("sample_first", '"rows"', '"rows" > 50000'),
            )
        ),
    ),
    "model_suggestion": Query(
        _orders(lambda df: advice.model_suggestion(df, rules=TARGETS)),
        f"""{FACTS}, {_target_sql(_ORDERS_SCORED, "dirty_orders")},
          best AS (SELECT "column", problem_type FROM targets ORDER BY score DESC, "column" LIMIT 1)
        SELECT best."column" AS target, problem_type, CASE WHEN "rows" < 1000 THEN l || ', decision tree'
            WHEN "rows" > 50000 OR columns > 20 THEN 'gradient boosting, random forest'
            ELSE 'random forest, gradient boosting, ' || l END AS model_families,
          CASE WHEN "rows" > 200000 THEN 'hard' WHEN "rows" > 50000 THEN 'moderate' ELSE 'easy' END AS difficulty,
          CASE WHEN health_score >= 85 THEN 'high' WHEN health_score >= 70 THEN 'medium' ELSE 'low' END AS confidence,
          CASE WHEN health_score >= 85 THEN 90 WHEN health_score >= 70 THEN 85 ELSE 70 END AS expected_low_pct,
          CASE WHEN health_score >= 85 THEN 95 WHEN health_score >= 70 THEN 90 ELSE 85 END AS expected_high_pct,
          text_columns > numeric_columns AS mostly_text
        FROM facts, health, best, (SELECT CASE WHEN problem_type = 'classification' THEN 'logistic regression'
          ELSE 'linear regression' END AS l FROM best)""",
    ),
}
