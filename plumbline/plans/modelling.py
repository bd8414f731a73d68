"""Registered modelling queries; SQL checks them wherever SQL can."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from plumbline.functions.schema import col
from plumbline.operators import knn, ml_metrics, ml_models, ml_prepare
from plumbline.plans.charting import counts_sql
from plumbline.plans.fixtures import Catalog, Query, cte, table
from plumbline.plans.profiling import ORDERS

_O, _S = cte("dirty_orders"), cte("scored_docs")
_CODED = ("o_orderstatus", "o_orderpriority")
_SCALED = ("l_quantity", "l_extendedprice", "l_discount")
_TARGETS = ("o_orderstatus", "o_totalprice", "o_orderpriority", "cents_text", "date_text", "is_even", "o_custkey")


def _code_sql(c, source):
    return f"(SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM ({counts_sql([c], source)}))"


def _encoded_sql(columns, all_columns, source):
    joins = " ".join(
        f"JOIN {_code_sql(c, source)} k{i} ON coalesce({c}, '(missing)') = k{i}.value" for i, c in enumerate(columns)
    )
    items = ", ".join(f"CAST(k{columns.index(c)}.code AS BIGINT) AS {c}" if c in columns else c for c in all_columns)
    return f"SELECT {items} FROM {source} {joins}"


def _problem_types(spark, sf):
    df = table(spark, sf, "dirty_orders")
    out = [ml_prepare.problem_type(df, t) for t in _TARGETS]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


def _problem_sql():
    def one(c):
        t = ORDERS[c]
        money = f"regexp_replace(trim({c}), '[,₹$€ ]', '', 'g')"
        base = f"regexp_replace({money}, '[KkMm]$', '')"
        parsed = f"count(CASE WHEN regexp_matches({base}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN 1 END)"
        if t == "string":
            numeric = f"{parsed} > 0.9e0 * count(*)"
            wide = f"(count(DISTINCT {c}) > 30 OR count(DISTINCT {c}) > 0.3e0 * count(*))"
            kind = f"CASE WHEN {numeric} OR {wide} THEN 'regression' ELSE 'classification' END"
            values = f"CASE WHEN {numeric} THEN 'parsed' ELSE 'codes' END"
        else:
            many = f"count(DISTINCT {c}) > 20" if t != "boolean" else "false"
            kind = f"CASE WHEN {many} THEN 'regression' ELSE 'classification' END"
            values = f"CASE WHEN {many} THEN 'as_is' ELSE 'codes' END"
        return f"""SELECT '{c}' AS target, {kind} AS problem_type, {values} AS target_values, count(DISTINCT {c}) AS "distinct"
          FROM dirty_orders WHERE {c} IS NOT NULL"""

    return _O + " UNION ALL ".join(map(one, _TARGETS))


def _split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ml_prepare.stratified_split(orders, "o_orderstatus", "o_orderkey")


def _unseen(spark, sf):
    known = ml_prepare.fit_codes(table(spark, sf, "orders"), list(_CODED))
    return ml_prepare.unseen_categories(table(spark, sf, "dirty_orders"), known, list(_CODED))


def _quality_rule(spark, sf):
    """A fixed rule as the classifier: long documents are good ones."""
    df = table(spark, sf, "scored_docs").where("quality is not null")
    return ml_metrics.classification_metrics(
        df.select(col("quality").alias("label"), (col("n_chars") >= 1000).cast("int").alias("prediction"))
    )


def _ols(spark, sf):
    """Least squares by the closed form as the predictor, judged on all rows."""
    df = table(spark, sf, "lineitem")
    line = df.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_intercept("l_extendedprice", "l_quantity")).first()
    return ml_metrics.regression_metrics(
        df.select(col("l_extendedprice").alias("label"), (col("l_quantity") * line[0] + line[1]).alias("prediction"))
    )


def _linear(spark, sf):
    """Spark ML least squares with one feature."""
    df = table(spark, sf, "lineitem").select(col("l_quantity"), col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    m = LinearRegression(regParam=0.0, solver="normal").fit(rows)
    return spark.createDataFrame(
        [(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"
    ).select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def _knn(spark, sf):
    df = table(spark, sf, "embeddings")
    found = knn.classify(df, df, "vec_id", "embedding", "label", k=5, exclude_self=True)
    return found.withColumnRenamed("query", "vec_id")


def docs_set(spark, sf):
    docs = table(spark, sf, "scored_docs")
    return ml_models.training_set(docs, "quality", ["lang", "source", "n_chars"], "doc_id", ml_models.CLASSIFICATION)


def parts_set(spark, sf):
    parts = table(spark, sf, "part")
    return ml_models.training_set(
        parts, "p_retailprice", ["p_partkey", "p_size", "p_brand", "p_type"], "p_partkey", ml_models.REGRESSION
    )


def _model(make, name):
    """Test-set metrics of one model, in long form."""

    def run(spark, sf):
        m = ml_models.fit_and_evaluate(make(spark, sf), name)
        head = ["model", "task", "approximate"]
        return m.unpivot(head, [c for c in m.columns if c not in head], "metric", "value")

    return run


def _leaderboard(make):
    return lambda spark, sf: ml_models.leaderboard(make(spark, sf))[0]


def _batch_score(spark, sf):
    """Score every document, labelled or not, with a tree fitted on the labelled ones."""
    data = docs_set(spark, sf)
    return ml_models.score(table(spark, sf, "scored_docs"), data, ml_models.fit(data, "decision_tree"))


def _rejected(spark, sf):
    """Orders whose category the model has not seen, or whose inputs are missing."""
    prep = ml_prepare.fit_preparation(table(spark, sf, "orders"), ["o_orderpriority", "o_totalprice"])
    return ml_models.rejected_rows(table(spark, sf, "dirty_orders"), prep).select("o_orderkey", "reason")


_FAMILIES = {
    "decision_tree": "decision_tree",
    "random_forest": "random_forest",
    "extra_trees": "extra_trees",
    "gbt": "gradient_boosting",
    "adaboost": "adaboost",
    "svm": "svm",
    "knn": "knn",
}
_CLASSIFIERS = {"logistic": "logistic_regression", **_FAMILIES}
_REGRESSORS = {"linear": "linear_regression", **_FAMILIES}

CATALOG: Catalog = {
    "label_encode": Query(
        lambda spark, sf: ml_prepare.label_encode(table(spark, sf, "dirty_orders"), list(_CODED)),
        f"{_O} {_encoded_sql(_CODED, ORDERS, 'dirty_orders')}",
    ),
    "factorize_target": Query(
        lambda spark, sf: ml_prepare.factorize_target(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand"),
        f"{_encoded_sql(('p_brand',), ('p_partkey', 'p_brand'), 'part')}",
    ),
    "standard_scale": Query(
        lambda spark, sf: ml_prepare.standard_scale(
            table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED), list(_SCALED), digits=6
        ),
        "SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
        + " FROM lineitem, (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
        + " FROM lineitem)",
    ),
    "problem_type": Query(_problem_types, _problem_sql()),
    "stratified_split": Query(
        _split,
        """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
            ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey)
            <= ceil(0.2e0 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test FROM orders""",
    ),
    "unseen_categories": Query(
        _unseen,
        f"""{_O}, seen AS ({counts_sql(_CODED, "dirty_orders")}), known AS ({counts_sql(_CODED, "orders")}),
          about AS (SELECT "column", count(*) AS allowed_count, string_agg(value, ', ' ORDER BY value) AS allowed
            FROM known GROUP BY 1)
        SELECT s."column", s.value, s.n, allowed_count, allowed FROM seen s JOIN about a ON s."column" = a."column"
        WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k."column" = s."column" AND k.value = s.value)""",
    ),
    "classification_metrics": Query(
        _quality_rule,
        f"""{_S}, p AS (SELECT quality AS l, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM scored_docs
            WHERE quality IS NOT NULL),
          c AS (SELECT DISTINCT l AS c FROM p UNION SELECT DISTINCT p FROM p),
          t AS (SELECT c, (SELECT count(*) FROM p WHERE l = c) * 1e0 AS a, (SELECT count(*) FROM p WHERE p = c) * 1e0 AS q,
            (SELECT count(*) FROM p WHERE p = c AND l = c) * 1e0 AS h FROM c),
          m AS (SELECT a, h, coalesce(h / nullif(q, 0), 0) AS pr, coalesce(h / nullif(a, 0), 0) AS re FROM t)
        SELECT round(sum(h) / sum(a) * 100, 2) AS accuracy, round(sum(pr * a) / sum(a) * 100, 2) AS precision,
          round(sum(re * a) / sum(a) * 100, 2) AS recall,
          round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * a) / sum(a) * 100, 2) AS f1 FROM m""",
    ),
    "regression_metrics": Query(
        _ols,
        """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i FROM lineitem),
          e AS (SELECT l_extendedprice y, l_extendedprice - (l_quantity * s + i) e FROM lineitem, m)
        SELECT round((1 - avg(e * e) / var_pop(y)) * 100, 2) AS r2, round(avg(abs(e)), 4) AS mae,
          round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e * e), 4) AS mse FROM e""",
    ),
    "knn_classify": Query(
        _knn,
        """WITH d AS (SELECT a.vec_id, b.vec_id AS other, b.label,
            list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
          FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
          n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS r FROM d),
          v AS (SELECT vec_id, label, count(*) AS c FROM n WHERE r <= 5 GROUP BY 1, 2)
        SELECT vec_id, arg_min(label, (-c, label)) AS prediction FROM v GROUP BY 1""",
    ),
    "ml_linear": Query(
        _linear,
        """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
          round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""",
    ),
    "rejected_rows": Query(
        _rejected,
        f"""{_O}, u AS (SELECT o_orderkey, CASE
            WHEN o_orderpriority IS NULL AND o_totalprice IS NULL THEN 'missing: o_orderpriority, o_totalprice'
            WHEN o_orderpriority IS NULL THEN 'missing: o_orderpriority'
            WHEN o_totalprice IS NULL THEN 'missing: o_totalprice'
            WHEN o_orderpriority NOT IN (SELECT o_orderpriority FROM orders) THEN 'unseen: o_orderpriority' END AS reason
          FROM dirty_orders) SELECT * FROM u WHERE reason IS NOT NULL""",
    ),
    **{f"ml_{key}": Query(_model(docs_set, name)) for key, name in _CLASSIFIERS.items()},
    **{f"ml_{key}_regression": Query(_model(parts_set, name)) for key, name in _REGRESSORS.items()},
    "model_leaderboard": Query(_leaderboard(docs_set)),
    "model_leaderboard_regression": Query(_leaderboard(parts_set)),
    "batch_score": Query(_batch_score),
}
