"""Registered queries whose fitted models SQL can check row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.schema import col, nan_to_null
from plumbline.operators import ml_models, ml_prepare
from plumbline.plans.fixtures import Catalog, Query, cte, table
from plumbline.plans.modelling import _CODED, _batch_score, _encoded_sql
from plumbline.plans.profiling import ORDERS

_O, _S = cte("dirty_orders"), cte("scored_docs")
_ORDERS_TEXT = [c for c, t in ORDERS.items() if t == "string"]


def _split_sql(source, key):
    """The rows of a table with the test rows of a regression marked."""
    return f"""SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || '|42'), {key})
      <= ceil(0.2e0 * count(*) OVER ()) AS is_test FROM {source}"""


def _predicted(source, target, features, key, name):
    """What a model fitted on the training rows says about every row."""

    def run(spark, sf):
        df = table(spark, sf, source)
        data = ml_models.training_set(df, target, features, key, ml_models.REGRESSION)
        found = ml_models.score(df, data, ml_models.fit(data, name))
        return found.select(key, F.round("prediction", 3).alias("prediction"))

    return run


def _problem_rows(spark, sf):
    """Labels that a money text and a wide text target turn into."""
    orders = table(spark, sf, "orders")
    money = F.concat(F.lit("$"), F.round("o_totalprice").cast("bigint").cast("string"))
    wide = F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    parts = []
    for how, text in (("parsed", money), ("codes", wide)):
        df = orders.select("o_orderkey", "o_custkey", text.alias("t"))
        data = ml_models.training_set(df, "t", ["o_custkey"], "o_orderkey", ml_models.REGRESSION)
        rows = data.train.select("__key", "label").union(data.test.select("__key", "label"))
        parts.append(rows.select(col("__key").alias("o_orderkey"), F.lit(how).alias("how"), "label"))
    return parts[0].union(parts[1])


def _encode_shuffled(spark, sf):
    df = nan_to_null(table(spark, sf, "dirty_orders"))
    codes = ml_prepare.fit_codes(df, list(_CODED), small_rows=0)
    return ml_prepare.encode(df, codes, list(_CODED), small_rows=0).select(*map(col, df.columns))


CATALOG: Catalog = {
    "ml_linear_predictions": Query(
        _predicted("orders", "o_totalprice", ["o_custkey"], "o_orderkey", "linear_regression"),
        f"""WITH s AS ({_split_sql("orders", "o_orderkey")}),
          m AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM s WHERE NOT is_test)
        SELECT o_orderkey, round(o_custkey * m.s + m.i, 3) AS prediction FROM orders, m""",
    ),
    "ml_knn_predictions": Query(
        _predicted("customer", "c_nationkey", ["c_acctbal", "c_custkey"], "c_custkey", "knn"),
        f"""WITH s AS ({_split_sql("customer", "c_custkey")}),
          m AS (SELECT avg(c_acctbal) a1, stddev_pop(c_acctbal) s1, avg(c_custkey) a2, stddev_pop(c_custkey) s2
            FROM s WHERE NOT is_test),
          z AS (SELECT c_custkey, c_nationkey, is_test, (c_acctbal - a1) / s1 AS x, (c_custkey - a2) / s2 AS y FROM s, m),
          d AS (SELECT a.c_custkey, b.c_nationkey, row_number() OVER (PARTITION BY a.c_custkey
            ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c_custkey) AS k FROM z a, z b WHERE NOT b.is_test)
        SELECT c_custkey, round(avg(c_nationkey), 3) AS prediction FROM d WHERE k <= 5 GROUP BY 1""",
    ),
    "batch_score_keys": Query(
        lambda spark, sf: _batch_score(spark, sf).select("doc_id"),
        f"""{_S}, s AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id)
            <= ceil(0.2e0 * count(*) OVER (PARTITION BY quality)) AS is_test FROM scored_docs WHERE quality IS NOT NULL)
        SELECT doc_id FROM scored_docs WHERE n_chars IS NOT NULL AND lang IN (SELECT lang FROM s WHERE NOT is_test)
          AND source IN (SELECT source FROM s WHERE NOT is_test)""",
    ),
    "ml_problem_rows": Query(
        _problem_rows,
        """SELECT o_orderkey, 'parsed' AS how, CAST(round(o_totalprice) AS DOUBLE) AS label FROM orders
        UNION ALL SELECT o_orderkey, 'codes',
          CAST(dense_rank() OVER (ORDER BY 'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) - 1 AS DOUBLE) FROM orders""",
    ),
    "label_encode_all_text": Query(
        lambda spark, sf: ml_prepare.label_encode(table(spark, sf, "dirty_orders"), _ORDERS_TEXT),
        f"{_O} {_encoded_sql(_ORDERS_TEXT, ORDERS, 'dirty_orders')}",
    ),
    # the same by range codes and shuffled joins, which otherwise start at 100,000 codes
    "label_encode_shuffled": Query(_encode_shuffled, f"{_O} {_encoded_sql(_CODED, ORDERS, 'dirty_orders')}"),
}
