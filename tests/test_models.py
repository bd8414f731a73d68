"""Preparation, splitting, neighbours, models and scoring."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from plumbline.operators import knn, ml_metrics, ml_models, ml_prepare
from plumbline.operators.ml_models import ModelSettings

SMALL = ModelSettings(trees=10, depth=4, boost_rounds=5, ada_rounds=4, fourier_features=64, max_iter=100)


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    data = []
    for i in range(240):
        x, kind = r.gauss(0, 1), r.choice(["red", "green", "blue"])
        y = 3.0 * x + {"red": 0.0, "green": 2.0, "blue": 4.0}[kind] + r.gauss(0, 0.1)
        data.append((i, x, kind, "yes" if y > 2 else "no", y))
    return spark.createDataFrame(data, "id bigint, x double, kind string, cls string, y double").cache()


@pytest.fixture(scope="module")
def sets(labelled):
    return {
        ml_models.CLASSIFICATION: ml_models.training_set(labelled, "cls", ["x", "kind"], "id", ml_models.CLASSIFICATION),
        ml_models.REGRESSION: ml_models.training_set(labelled, "y", ["x", "kind"], "id", ml_models.REGRESSION),
    }


# --- codes -------------------------------------------------------------------


def test_codes_by_range_equal_small_codes(spark):
    df = spark.createDataFrame([(f"v{i % 97}", None if i % 3 else f"w{i}") for i in range(400)], "a string, b string")
    small = ml_prepare.fit_codes(df, ["a", "b"])
    large = ml_prepare.fit_codes(df, ["a", "b"], small_rows=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_encode_with_hot_and_cold_values(spark):
    values = ["hot"] * 3000 + [f"cold{i}" for i in range(2500)] + [None] * 10
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    codes = ml_prepare.fit_codes(df, ["s"])
    a = ml_prepare.encode(df, codes, ["s"])
    b = ml_prepare.encode(df, codes, ["s"], small_rows=5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("s is null").count() == 0


def test_codes_decode_to_the_same_values(spark, labelled):
    codes = ml_prepare.fit_codes(labelled, ["kind"])
    back = {r["code"]: r["value"] for r in codes.collect()}
    coded = ml_prepare.encode(labelled.select("id", "kind"), codes, ["kind"])
    for r in coded.join(labelled.select("id", F.col("kind").alias("was")), "id").collect():
        assert back[r["kind"]] == r["was"]


# --- split -------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_split_sizes_are_exact_per_class(spark, share):
    df = spark.createDataFrame([(i, "a" if i % 3 else ("b" if i % 2 else None)) for i in range(997)], "id bigint, c string")
    out = ml_prepare.stratified_split(df, "c", "id", share)
    assert out.count() == 997
    for r in out.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == int(np.ceil(share * r["n"]))


def test_split_ignores_classes_when_one_has_a_single_row(spark):
    df = spark.createDataFrame([(i, "only" if i == 0 else "rest") for i in range(101)], "id bigint, c string")
    assert ml_prepare.stratified_split(df, "c", "id").where("is_test").count() == 21


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("c"))
    a = ml_prepare.stratified_split(df, "c", "id")
    b = ml_prepare.stratified_split(df.repartition(7), "c", "id")
    assert set(map(tuple, a.collect())) == set(map(tuple, b.collect()))


# --- neighbours --------------------------------------------------------------


def brute(train, query, k, exclude_self):
    out = {}
    for qid, q in query:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in train if not (exclude_self and i == qid))
        out[qid] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
def test_neighbors_match_brute_force_with_clusters_and_copies(spark, exclude_self):
    r = np.random.default_rng(7)
    centers = r.normal(0, 10, (6, 5))
    train = [(i, (centers[i % 6] + r.normal(0, 0.5, 5)).tolist()) for i in range(300)]
    train += [(300 + i, [1.0] * 5) for i in range(150)]  # a third of all points are one point
    query = train if exclude_self else [(1000 + i, (centers[i % 6] + r.normal(0, 3, 5)).tolist()) for i in range(60)] + [(2000, [1.0] * 5)]
    schema = "id bigint, v array<double>"
    found = knn.nearest(
        spark.createDataFrame(train, schema), spark.createDataFrame(query, schema), "id", "v", 5,
        exclude_self=exclude_self, block_rows=40, chunk_rows=16, pivots=12,
    )
    got = {}
    for row in found.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append(row["neighbor"])
    assert got == brute(train, query, 5, exclude_self)


def test_neighbors_skip_far_cells(spark):
    train = [(i, [float(i % 2) * 1000.0 + i * 1e-3]) for i in range(200)]
    df = spark.createDataFrame(train, "id bigint, v array<double>")
    assert knn.nearest(df, df.where("id < 4"), "id", "v", 3, pivots=8).count() == 12


def test_of_equal_distances_the_smallest_keys_win(spark):
    train = [(i, [float(i >= 400), 1.0]) for i in np.random.default_rng(3).permutation(600).tolist()]
    query = [(1000 + i, [float(i % 2), 1.0]) for i in range(6)]
    schema = "id bigint, v array<double>"
    found = knn.nearest(spark.createDataFrame(train, schema), spark.createDataFrame(query, schema), "id", "v", 5, pivots=1)
    got = {}
    for row in found.orderBy("query", "rank").collect():
        got.setdefault(row["query"], []).append(row["neighbor"])
    assert got == brute(train, query, 5, False)


def test_queries_travel_once_to_a_block_in_small_messages(spark, monkeypatch):
    """Vectors without clusters skip nothing; a task must still never hold its queries times the cells."""
    r = np.random.default_rng(5)
    vectors = r.normal(0, 1, (4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    sent, plain = {}, type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, *a, **b: sent.update({f.__name__: f}) or plain(self, f, *a, **b))
    knn.nearest(df, df, "id", "v", 3, exclude_self=True)
    batch = pd.DataFrame({"qid": np.arange(4000), "qvec": list(vectors)})
    made = [len(m) for m in sent["carry"](iter([batch]))]
    assert max(made) <= knn.MESSAGE and sum(made) <= 2 * len(batch)


def test_fewer_points_than_neighbors(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id bigint, v array<double>")
    assert knn.nearest(df, df, "id", "v", 5).count() == 4


# --- metrics -----------------------------------------------------------------


def test_metrics_of_a_never_predicted_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    m = ml_metrics.classification_metrics(df).first()
    assert m["accuracy"] == 75.0 and m["recall"] == 75.0
    assert m["precision"] == pytest.approx(100 * (2 / 3 * 2 + 0 + 1) / 4, abs=0.01)


def test_regression_metrics_of_a_perfect_and_a_flat_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    assert tuple(ml_metrics.regression_metrics(df).first()) == (100.0, 0.0, 0.0, 0.0)
    flat = spark.createDataFrame([(1.0, 2.0)], "label double, prediction double")
    assert ml_metrics.regression_metrics(flat).first()["r2"] is None


# --- problem type ------------------------------------------------------------


def test_problem_types(spark):
    rows = [(f"${i},000", "a" if i % 2 else "b", f"t{i}", i, i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "money string, few string, wide string, n int, flag boolean")
    got = {t: ml_prepare.problem_type(df, t).first()[1:3] for t in df.columns}
    assert got == {
        "money": ("regression", "parsed"),
        "few": ("classification", "codes"),
        "wide": ("regression", "codes"),
        "n": ("regression", "as_is"),
        "flag": ("classification", "codes"),
    }


# --- models ------------------------------------------------------------------


@pytest.mark.parametrize("name", list(ml_models.CLASSIFIERS))
def test_classifiers_beat_chance(sets, name):
    data = sets[ml_models.CLASSIFICATION]
    m = ml_models.fit_and_evaluate(data, name, SMALL).first()
    assert m["accuracy"] > 75, m


@pytest.mark.parametrize("name", list(ml_models.REGRESSORS))
def test_regressors_explain_the_target(sets, name):
    data = sets[ml_models.REGRESSION]
    m = ml_models.fit_and_evaluate(data, name, SMALL).first()
    assert m["r2"] > 50, m


def test_three_classes(spark, labelled):
    data = ml_models.training_set(labelled, "kind", ["x", "y"], "id", ml_models.CLASSIFICATION)
    for name in ("gradient_boosting", "adaboost", "svm", "logistic_regression", "knn"):
        assert ml_models.fit_and_evaluate(data, name, SMALL).first()["accuracy"] > 40


def test_leaderboard_is_sorted_and_split_is_shared(sets):
    board, models = ml_models.leaderboard(sets[ml_models.CLASSIFICATION], SMALL, ["decision_tree", "logistic_regression", "knn"])
    got = [r["accuracy"] for r in board.collect()]
    assert got == sorted(got, reverse=True) and len(models) == 3


@pytest.mark.parametrize("name", ["decision_tree", "adaboost", "svm", "knn", "extra_trees"])
def test_saved_models_score_the_same(spark, labelled, sets, tmp_path, name):
    data = sets[ml_models.CLASSIFICATION]
    model = ml_models.fit(data, name, SMALL)
    ml_models.save_model(model, data, str(tmp_path / "m"))
    again, about = ml_models.load_model(spark, str(tmp_path / "m"))
    a = ml_models.score(labelled, data, model)
    b = ml_models.score(labelled, about, again)
    assert set(r["prediction"] for r in a.collect()) <= {"yes", "no"}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rows_with_gaps_or_new_categories_are_rejected(spark, sets):
    data = sets[ml_models.CLASSIFICATION]
    new = spark.createDataFrame(
        [(1, 0.5, "red"), (2, None, "red"), (3, 0.5, "violet"), (4, 0.5, None)], "id bigint, x double, kind string"
    )
    reasons = {r["id"]: r["reason"] for r in ml_models.rejected_rows(new, data.prep).collect()}
    assert reasons == {2: "missing: x", 3: "unseen: kind", 4: "missing: kind"}
    model = ml_models.fit(data, "decision_tree", SMALL)
    assert [r["id"] for r in ml_models.score(new, data, model).collect()] == [1]
    unseen = ml_models.unseen_inputs(new, data.prep).where("value = 'violet'").first()
    assert unseen["allowed"] == "blue, green, red" and unseen["n"] == 1


def test_rows_are_dealt_to_all_cores_whatever_their_files(spark, monkeypatch):
    """A million rows of few numbers are one small file, which one task would read and learn from."""
    df = spark.range(20000).selectExpr("id", "CAST(id % 97 AS DOUBLE) AS x", "CAST(id % 89 AS DOUBLE) AS y")
    data = ml_models.training_set(df.coalesce(1), "y", ["x"], "id", ml_models.REGRESSION)
    assert data.train.rdd.getNumPartitions() == 1
    seen = {}

    def fitter(train, settings, info):
        seen["train"] = train.rdd.getNumPartitions()
        mapped = ml_models._bounded_parts(train, info["rows"], 2000)
        seen["mapped"] = max(mapped.rdd.glom().map(len).collect())
        return ml_models._fit_single("linear", ml_models.REGRESSION, lambda s, i: LinearRegression())(train, settings, info)

    monkeypatch.setitem(ml_models.REGRESSORS, "linear_regression", fitter)
    ml_models.fit_and_evaluate(data, "linear_regression").collect()
    board, _ = ml_models.leaderboard(data, names=["linear_regression"])
    assert board.count() == 1 and seen["train"] == 16000 // ml_models.ROWS_PER_CORE and seen["mapped"] <= 2100
