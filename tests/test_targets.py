"""Training on the targets and keys that people have."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.schema import col
from plumbline.operators import knn, ml_models, ml_prepare
from plumbline.operators.ml_prepare import _cut_hashes, split_hash
from plumbline.plans.registry import CATALOG


@pytest.fixture(scope="module")
def houses(spark):
    rows = [(f"key-{i:04d}", i % 17, i % 5, f"${100 + (i % 17) * 10},000", f"code {i % 17:02d}", ["a", "b"][i % 17 > 8]) for i in range(200)]
    return spark.createDataFrame(rows, "k string, x int, y int, price string, code string, side string")


def test_money_text_becomes_the_numbers_it_spells(houses):
    data = ml_models.training_set(houses, "price", ["x", "y"], "k", ml_models.REGRESSION)
    labels = {r["__key"]: r["label"] for r in data.train.union(data.test).collect()}
    assert labels["key-0003"] == 130_000 and len(labels) == 200
    model = ml_models.fit(data, "linear_regression")
    assert ml_models.evaluate(data, model).first()["r2"] > 99.9


def test_wide_text_becomes_codes_and_the_task_follows(houses):
    data = ml_models.training_set(houses, "code", ["x"], "k", ml_models.REGRESSION)
    assert {r["__key"]: r["label"] for r in data.train.union(data.test).collect()}["key-0016"] == 16
    assert ml_models.training_set(houses, "side", ["x"], "k").task == ml_models.CLASSIFICATION
    assert ml_models.training_set(houses, "price", ["x"], "k").task == ml_models.REGRESSION


def test_text_keys_repeated_keys_and_the_best_model(houses):
    data = ml_models.training_set(houses, "side", ["x"], "k")
    model = ml_models.best(data, names=["decision_tree", "knn"])
    assert model.name in ("decision_tree", "knn")
    near = ml_models.fit(data, "knn")
    twice = houses.limit(0).union(houses.where("k in ('key-0000', 'key-0016')")).withColumn("k", col("k").substr(1, 4))
    got = sorted(r["prediction"] for r in ml_models.score(twice, data, near).collect())
    assert got == ["a", "b"]


def test_neighbours_by_text_keys(spark):
    points = spark.createDataFrame([(k, [float(i), 0.0], i % 2) for i, k in enumerate("abcdef")], "k string, v array<double>, l int")
    rows = knn.nearest(points, points, "k", "v", 1, exclude_self=True).collect()
    assert {r["query"]: r["neighbor"] for r in rows} == {"a": "b", "b": "a", "c": "b", "d": "c", "e": "d", "f": "e"}


def test_encoding_reads_its_input_once(spark, tmp_path):
    spark.range(50).selectExpr(*[f"concat('v', id % {n + 2}) AS c{n}" for n in range(6)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    names = df.columns
    codes = ml_prepare.materialize(ml_prepare.fit_codes(df, names), "codes")
    for small in (100_000, 0):
        plan = ml_prepare.encode(df, codes, names, small_rows=small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("c0#") > 0 and plan.count("Relation [c0#") == 1
        assert ml_prepare.encode(df, codes, names, small_rows=small).where("c3 is null").count() == 0


def test_the_linear_fit_reads_all_of_lineitem(spark, sf_dir, con):
    query = CATALOG["ml_linear"]
    assert [tuple(r) for r in query.run(spark, sf_dir).select("slope", "intercept").collect()] == con.execute(query.oracle).fetchall()
    assert "ml_linear_predictions" in CATALOG


def test_a_classification_asked_for_is_never_switched(spark):
    wide = spark.range(1001).selectExpr("id AS k", "concat('c', id) AS t", "double(id) AS x")
    with pytest.raises(ValueError, match="1001 classes"):
        ml_models.training_set(wide, "t", ["x"], "k", ml_models.CLASSIFICATION)
    assert ml_models.training_set(wide, "t", ["x"], "k").task == ml_models.REGRESSION


def test_a_split_does_not_shuffle_its_rows_to_meet_the_cut(spark):
    """All rows of a regression are one class, so a shuffle by class would send them all to one task."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # tables beyond it, whatever their size
    try:
        hashed = spark.range(5000).select(F.lit("all").alias("__class"), split_hash("id", 42).alias("__hash"))
        cuts = _cut_hashes(hashed, 0.2)
        assert "SortMergeJoin" not in cuts._jdf.queryExecution().executedPlan().toString()
        want = sorted(r["__hash"] for r in hashed.collect())[999]
        assert [tuple(r) for r in cuts.collect()] == [("all", want)]
    finally:
        spark.conf.set(threshold, kept)
