"""Eight models per task on Spark ML, a leaderboard, and batch scoring.

Preparation is fitted on training rows only.  Four models have no twin in Spark ML;
two of them are approximations, marked so in the leaderboard:

* extra trees are grown with random cuts (``operators.random_trees``), and so are
  regression forests over many rows, by Spark's own method (``operators.bagged_trees``);
* AdaBoost: SAMME (classification) and R2 (regression) over weighted trees;
* RBF support vector machines: random Fourier features and a linear model;
* nearest neighbours are exact (``operators.knn``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from plumbline.functions.exprs import currency_to_number
from plumbline.functions.schema import TEXT, col, family, nan_to_null
from plumbline.operators import bagged_trees, knn, random_trees
from plumbline.operators.ml_metrics import classification_metrics, regression_metrics
from plumbline.operators.ml_prepare import (
    Preparation,
    as_category,
    encode,
    fit_codes,
    fit_preparation,
    model_input,
    problem_type,
    stratified_split,
    unseen_categories,
)
from plumbline.session import materialize, release

CLASSIFICATION, REGRESSION = "classification", "regression"
# Classes of a classifier's target at most; beyond them it is a regression on codes.
MAX_CLASSES = 1000
# Rounds of reweighting between two writes of the weighted rows.
ROUNDS_PER_CUT = 8
# A table of fewer rows for each core than this is not dealt out anew.
ROWS_PER_CORE = 4096
# Rows of a partition of Fourier features at most: 64 MB of them.
FOURIER_ROWS = 32768
# Training rows up to which Spark's own regression forest is grown; beyond them its work for each row and tree is what counts.
FOREST_ROWS = 65536


@dataclass(frozen=True)
class ModelSettings:
    trees: int = 300
    depth: int = 10
    boost_rounds: int = 100
    boost_depth: int = 3
    ada_rounds: int = 50
    ada_depth: int = 3
    neighbors: int = 5
    fourier_features: int = 256
    max_iter: int = 5000
    seed: int = 42


@dataclass
class Fitted:
    """A predictor over the ``features`` vector: ``predict`` adds ``prediction``."""

    name: str
    task: str
    stages: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        return PREDICTORS[self.name if self.name in PREDICTORS else "single"](self, df)


# --- predictors --------------------------------------------------------------


def _single(model: Fitted, df: DataFrame) -> DataFrame:
    out = model.stages[0].transform(df)
    return out.select(*df.columns, "prediction")


def _fourier(df: DataFrame, extra: dict) -> DataFrame:
    """Random Fourier features of an RBF kernel, computed per Arrow batch."""
    dim, count, gamma, seed = (extra[k] for k in ("dim", "count", "gamma", "seed"))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, math.sqrt(2.0 * gamma), (dim, count))
        b = rng.uniform(0.0, 2.0 * math.pi, count)
        z = math.sqrt(2.0 / count) * np.cos(np.stack(x.to_list()) @ w + b)
        return pd.Series(list(z))

    return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def _svm(model: Fitted, df: DataFrame) -> DataFrame:
    """Prediction on the mapped features, with the original features kept."""
    kept = df.withColumnRenamed("features", "__features").withColumn("features", F.col("__features"))
    out = model.stages[0].transform(_fourier(kept, model.extra))
    return out.select(*[F.col("__features").alias("features") if c == "features" else col(c) for c in df.columns], "prediction")


def _ada_classify(model: Fitted, df: DataFrame) -> DataFrame:
    """Weighted vote of the rounds; all rounds run in one pass over the rows."""
    classes, out = model.extra["classes"], df
    for i, stage in enumerate(model.stages):
        out = stage.transform(out).withColumnRenamed("prediction", f"__p{i}").drop("rawPrediction", "probability")
    votes = [
        F.struct(
            sum((F.when(F.col(f"__p{i}") == c, w).otherwise(0.0) for i, w in enumerate(model.weights)), F.lit(0.0)).alias("v"),
            F.lit(-c).alias("c"),
        )
        for c in range(classes)
    ]
    return out.withColumn("prediction", -F.array_max(F.array(*votes))["c"].cast("double")).select(*df.columns, "prediction")


def _ada_regress(model: Fitted, df: DataFrame) -> DataFrame:
    """Weighted median of the rounds."""
    out = df
    for i, stage in enumerate(model.stages):
        out = stage.transform(out).withColumnRenamed("prediction", f"__p{i}")
    half = sum(model.weights) / 2
    pairs = F.array_sort(F.array(*[F.struct(F.col(f"__p{i}").alias("p"), F.lit(w).alias("w")) for i, w in enumerate(model.weights)]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(acc, x):
        total = acc["sum"] + x["w"]
        return F.struct(total.alias("sum"), F.when(acc["at"].isNull() & (total >= half), x["p"]).otherwise(acc["at"]).alias("at"))

    return out.withColumn("prediction", F.aggregate(pairs, start, step)["at"]).select(*df.columns, "prediction")


def _knn(model: Fitted, df: DataFrame) -> DataFrame:
    """Rows get numbers of their own, written once, so keys may repeat or be text."""
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "asked")
    rows = numbered.withColumn("__vec", vector_to_array("features"))
    run = knn.classify if model.task == CLASSIFICATION else knn.regress
    found = run(model.extra["train"], rows, "__row", "__vec", "label", model.extra["k"])
    return numbered.join(found.withColumnRenamed("query", "__row"), "__row").select(*df.columns, "prediction")


def _extra_trees(model: Fitted, df: DataFrame) -> DataFrame:
    return random_trees.predict(df, model.extra["forest"])


PREDICTORS: dict[str, Callable[[Fitted, DataFrame], DataFrame]] = {
    "extra_trees": _extra_trees,
    "bagged_trees": _extra_trees,
    "single": _single,
    "svm": _svm,
    "ada_classify": _ada_classify,
    "ada_regress": _ada_regress,
    "knn": _knn,
}


# --- fitting -----------------------------------------------------------------


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """A model's work is far more than its rows' bytes, by which files are cut: rows go to all cores alike."""
    cores = min(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_CORE)
    # parts of a file may be empty, because a row group is never cut, so their number tells nothing
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if cores > 1 else df


def _bounded_parts(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Partitions of at most about ``most`` rows."""
    parts = math.ceil(rows / most)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


@contextmanager
def _kept(data: TrainingSet) -> Iterator[DataFrame]:
    """The training rows, dealt out and cached."""
    train = _dealt(data.train, data.info["rows"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield train
    finally:
        train.unpersist()


def _fit_single(name, task, estimator):
    return lambda train, s, info: Fitted(name, task, [estimator(s, info).fit(train)])


def _one_vs_rest(binary, info):
    return binary if info["classes"] <= 2 else C.OneVsRest(classifier=binary)


def _fit_svm(task):
    def fit(train, s, info):
        extra = {"dim": info["dim"], "count": s.fourier_features, "gamma": 1.0 / info["dim"], "seed": s.seed}
        mapped = _fourier(_bounded_parts(train, info["rows"], FOURIER_ROWS), extra).persist(StorageLevel.MEMORY_AND_DISK)
        if task == CLASSIFICATION:
            est = _one_vs_rest(C.LinearSVC(maxIter=100, regParam=1.0 / info["rows"]), info)
        else:
            est = R.LinearRegression(loss="huber", maxIter=200, regParam=1.0 / info["rows"])
        model = Fitted("svm", task, [est.fit(mapped)], extra=extra)
        mapped.unpersist()
        return model

    return fit


class _Rounds:
    """Reweighted rows; written every few rounds, so the plan does not grow with the rounds.

    The table before is then needed no more; the last goes with ``release``.
    """

    def __init__(self) -> None:
        self.kept: DataFrame | None = None

    def next(self, rows: DataFrame, i: int) -> DataFrame:
        if i % ROUNDS_PER_CUT != ROUNDS_PER_CUT - 1:
            return rows
        before, self.kept = self.kept, materialize(rows, "boost")
        if before is not None:
            release(before)
        return self.kept

    def release(self) -> None:
        if self.kept is not None:
            release(self.kept)


def _fit_ada_classify(train, s, info):
    """SAMME: each round reweights the rows the round got wrong."""
    k, out = max(2, info["classes"]), Fitted("ada_classify", CLASSIFICATION, extra={"classes": max(2, info["classes"])})
    rows, rounds = train.withColumn("__w", F.lit(1.0)), _Rounds()
    for i in range(s.ada_rounds):
        tree = C.DecisionTreeClassifier(maxDepth=1, weightCol="__w", seed=s.seed + i).fit(rows)
        wrong = F.col("prediction") != F.col("label")
        judged = tree.transform(rows)
        e = judged.agg((F.sum(F.when(wrong, F.col("__w")).otherwise(0.0)) / F.sum("__w")).alias("e")).first()["e"]
        if e >= 1.0 - 1.0 / k:
            break
        alpha = math.log(max(1.0 - e, 1e-10) / max(e, 1e-10)) + math.log(k - 1.0)
        out.stages.append(tree)
        out.weights.append(alpha)
        if e <= 1e-10 or i + 1 == s.ada_rounds:
            break
        judged = judged.withColumn("__w", F.col("__w") * F.when(wrong, math.exp(alpha)).otherwise(1.0))
        rows = rounds.next(judged.select(*rows.columns), i)
    rounds.release()
    if not out.stages:
        out.stages, out.weights = [tree], [1.0]
    return out


def _fit_ada_regress(train, s, info):
    """AdaBoost.R2 with linear loss, over weighted trees instead of resampled ones."""
    out = Fitted("ada_regress", REGRESSION)
    rows, rounds = train.withColumn("__w", F.lit(1.0)), _Rounds()
    for i in range(s.ada_rounds):
        tree = R.DecisionTreeRegressor(maxDepth=s.ada_depth, weightCol="__w", seed=s.seed + i).fit(rows)
        judged = tree.transform(rows).withColumn("__e", F.abs(F.col("prediction") - F.col("label")))
        facts = judged.agg(F.max("__e").alias("top"), (F.sum(F.col("__e") * F.col("__w")) / F.sum("__w")).alias("mean")).first()
        top = facts["top"] or 0.0
        loss = facts["mean"] / top if top else 0.0
        if loss >= 0.5 and out.stages:
            break
        beta = max(loss, 1e-10) / max(1.0 - loss, 1e-10)
        out.stages.append(tree)
        out.weights.append(math.log(1.0 / beta) if loss < 0.5 else 1.0)
        if loss == 0.0 or loss >= 0.5 or i + 1 == s.ada_rounds:
            break
        judged = judged.withColumn("__w", F.col("__w") * F.pow(F.lit(beta), 1.0 - F.col("__e") / top))
        rows = rounds.next(judged.select(*rows.columns), i)
    rounds.release()
    return out


def _fit_knn(task):
    def fit(train, s, info):
        # numbered in order of key, which is what breaks ties between neighbours
        rows = train.select("__key", vector_to_array("features").alias("__vec"), "label").orderBy("__key", "label")
        rows = materialize(rows.select(F.monotonically_increasing_id().alias("__row"), "__vec", "label"), "neighbors")
        return Fitted("knn", task, extra={"train": rows, "k": s.neighbors})

    return fit


def _fit_extra_trees(task):
    def fit(train, s, info):
        classes = info["classes"] if task == CLASSIFICATION else 0
        forest = random_trees.grow(train, info["dim"], classes, s.trees, s.depth, seed=s.seed)
        return Fitted("extra_trees", task, extra={"forest": forest, "trees": s.trees})

    return fit


def _fit_forest_regress(train, s, info):
    """Spark's own forest where rows are few, else the same method on blocks of rows."""
    if info["rows"] <= FOREST_ROWS:
        own = R.RandomForestRegressor(numTrees=s.trees, maxDepth=s.depth, seed=s.seed, featureSubsetStrategy="all")
        return Fitted("random_forest", REGRESSION, [own.fit(train)])
    forest = bagged_trees.grow(train, info["dim"], s.trees, s.depth, s.seed)
    return Fitted("bagged_trees", REGRESSION, extra={"forest": forest, "trees": s.trees})


CLASSIFIERS: dict[str, Callable] = {
    "random_forest": _fit_single(
        "random_forest",
        CLASSIFICATION,
        lambda s, i: C.RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, seed=s.seed),
    ),
    "extra_trees": _fit_extra_trees(CLASSIFICATION),
    "gradient_boosting": _fit_single(
        "gradient_boosting",
        CLASSIFICATION,
        lambda s, i: _one_vs_rest(
            C.GBTClassifier(maxIter=s.boost_rounds, maxDepth=s.boost_depth, stepSize=0.1, seed=s.seed), i
        ),
    ),
    "adaboost": _fit_ada_classify,
    "logistic_regression": _fit_single(
        "logistic_regression",
        CLASSIFICATION,
        lambda s, i: C.LogisticRegression(maxIter=s.max_iter, regParam=1.0 / i["rows"], standardization=False),
    ),
    "decision_tree": _fit_single(
        "decision_tree", CLASSIFICATION, lambda s, i: C.DecisionTreeClassifier(maxDepth=s.depth, seed=s.seed)
    ),
    "knn": _fit_knn(CLASSIFICATION),
    "svm": _fit_svm(CLASSIFICATION),
}

REGRESSORS: dict[str, Callable] = {
    "random_forest": _fit_forest_regress,
    "extra_trees": _fit_extra_trees(REGRESSION),
    "gradient_boosting": _fit_single(
        "gradient_boosting",
        REGRESSION,
        lambda s, i: R.GBTRegressor(maxIter=s.boost_rounds, maxDepth=s.boost_depth, stepSize=0.1, seed=s.seed),
    ),
    "adaboost": _fit_ada_regress,
    "linear_regression": _fit_single(
        "linear_regression", REGRESSION, lambda s, i: R.LinearRegression(regParam=0.0, solver="normal")
    ),
    "decision_tree": _fit_single(
        "decision_tree", REGRESSION, lambda s, i: R.DecisionTreeRegressor(maxDepth=s.depth, seed=s.seed)
    ),
    "knn": _fit_knn(REGRESSION),
    "svm": _fit_svm(REGRESSION),
}

APPROXIMATE = {"adaboost", "svm"}


# --- training data -----------------------------------------------------------


@dataclass
class TrainingSet:
    task: str
    target: str
    key: str
    prep: Preparation
    classes: list[str]
    train: DataFrame
    test: DataFrame
    info: dict
    written: DataFrame | None = None

    def release(self) -> None:
        """Delete the table both parts are read from; neither can be read afterwards."""
        if self.written is not None:
            release(self.written)


def vectors(df: DataFrame, prep: Preparation) -> DataFrame:
    return VectorAssembler(inputCols=prep.features, outputCol="features").transform(model_input(df, prep))


def training_set(
    df: DataFrame, target: str, features: list[str], key: str, task: str | None = None, seed: int = 42
) -> TrainingSet:
    """Split, prepare and write once; all models then read the same two tables.

    The key may have any type.  Without a ``task`` the target decides it
    (``problem_type``).  A text target of a regression becomes numbers: those it
    spells, such as money, or else its codes in text order.  So does, without a
    ``task``, a target of more than ``MAX_CLASSES`` classes, which no classifier
    here can tell apart; a classification asked for on one is an error.
    """
    df = nan_to_null(df).where(col(target).isNotNull()).select(*map(col, dict.fromkeys((key, target, *features))))
    facts = problem_type(df, target).first()
    many = facts["distinct"] > MAX_CLASSES
    if task == CLASSIFICATION and many:
        raise ValueError(f"{target} has {facts['distinct']} classes, more than the {MAX_CLASSES} a classification can have")
    task = task or (REGRESSION if many else facts["problem_type"])
    if task == CLASSIFICATION:
        split = stratified_split(df, target, key, seed=seed)
    else:
        split = stratified_split(df.withColumn("__all", F.lit(1)), "__all", key, seed=seed).drop("__all")
    train = split.where(~F.col("is_test"))
    prep = fit_preparation(train, features)
    classes: list[str] = []
    if task == CLASSIFICATION:
        # Spark ML needs the classes of a target as a small, dense range.
        classes = sorted(r[0] for r in df.select(as_category(col(target))).distinct().collect())
        label = F.array_position(F.array(*map(F.lit, classes)), as_category(col(target))).cast("double") - 1
    elif family(df.schema[target].dataType) != TEXT:
        label = col(target).cast("double")
    elif facts["target_values"] == "parsed":
        label = currency_to_number(col(target))
    else:
        split = split.withColumn("__target", col(target))
        split = encode(split, fit_codes(split, ["__target"]), ["__target"])
        label = col("__target").cast("double")
    rows = split.withColumns({"__key": col(key), "label": label}).where("label is not null")
    ready = materialize(vectors(rows, prep).select("__key", "features", "label", "is_test"), "training")
    parts = [ready.where(cond).drop("is_test") for cond in (~F.col("is_test"), F.col("is_test"))]
    info = {"rows": parts[0].count(), "dim": len(features), "classes": len(classes)}
    return TrainingSet(task, target, key, prep, classes, *parts, info, ready)


def fit(data: TrainingSet, name: str, settings: ModelSettings = ModelSettings()) -> Fitted:
    with _kept(data) as train:
        return _fit_on(train, data, name, settings)


def _fit_on(train: DataFrame, data: TrainingSet, name: str, settings: ModelSettings) -> Fitted:
    fitters = CLASSIFIERS if data.task == CLASSIFICATION else REGRESSORS
    return fitters[name](train, settings, data.info)


def evaluate(data: TrainingSet, model: Fitted) -> DataFrame:
    scored = model.predict(_dealt(data.test, data.info["rows"] // 4))
    return classification_metrics(scored) if data.task == CLASSIFICATION else regression_metrics(scored)


def fit_and_evaluate(data: TrainingSet, name: str, settings: ModelSettings = ModelSettings()) -> DataFrame:
    metrics = evaluate(data, fit(data, name, settings))
    return metrics.select(
        F.lit(name).alias("model"), F.lit(data.task).alias("task"), F.lit(name in APPROXIMATE).alias("approximate"), "*"
    )


def leaderboard(
    data: TrainingSet,
    settings: ModelSettings = ModelSettings(),
    names: list[str] | None = None,
    parallelism: int = 4,
) -> tuple[DataFrame, dict[str, Fitted]]:
    """Every model on the same split, best first; the first of equals wins.

    A few fits run side by side, because boosting is a long row of small jobs that
    leaves a cluster idle; the training rows are cached once for all of them.
    """
    names = names or list(CLASSIFIERS if data.task == CLASSIFICATION else REGRESSORS)
    spark = data.train.sparkSession

    with _kept(data) as train, ThreadPoolExecutor(parallelism) as pool:

        def run(name):
            model = _fit_on(train, data, name, settings)
            return model, evaluate(data, model).first().asDict()

        found = list(pool.map(inheritable_thread_target(spark)(run), names))
    rows = [(i, n, n in APPROXIMATE, *m.values()) for i, (n, (_, m)) in enumerate(zip(names, found))]
    metrics = list(found[0][1])
    schema = "position int, model string, approximate boolean, " + ", ".join(f"{k} double" for k in metrics)
    board = spark.createDataFrame(rows, schema).orderBy(F.desc(metrics[0]), "position").drop("position")
    return board, {n: model for n, (model, _) in zip(names, found)}


def best(data: TrainingSet, settings: ModelSettings = ModelSettings(), names: list[str] | None = None) -> Fitted:
    """The model that leads the leaderboard."""
    board, models = leaderboard(data, settings, names)
    return models[board.first()["model"]]


# --- scoring -----------------------------------------------------------------


def rejected_rows(df: DataFrame, prep: Preparation) -> DataFrame:
    """Rows that cannot be scored, with the reason: a missing input, or an unseen category."""
    return _judged(df, prep).where("reason is not null")


def _judged(df: DataFrame, prep: Preparation) -> DataFrame:
    df = nan_to_null(df)
    missing = F.concat_ws(", ", *[F.when(col(c).isNull(), F.lit(c)) for c in prep.features])
    reason = F.when(missing != "", F.concat(F.lit("missing: "), missing))
    if prep.text:
        marks = df.withColumns({f"__code_{i}": col(c) for i, c in enumerate(prep.text)})
        names = {c: f"__code_{i}" for i, c in enumerate(prep.text)}
        swap = F.create_map(*[x for c, n in names.items() for x in (F.lit(c), F.lit(n))])
        codes = prep.codes.withColumn("column", swap[F.col("column")])
        marks = encode(marks, codes, list(names.values()))
        unseen = F.concat_ws(", ", *[F.when(col(c).isNotNull() & F.col(n).isNull(), F.lit(c)) for c, n in names.items()])
        reason = F.coalesce(reason, F.when(unseen != "", F.concat(F.lit("unseen: "), unseen)))
        return marks.withColumn("reason", reason).select(*map(col, df.columns), "reason")
    return df.withColumn("reason", reason)


def score(df: DataFrame, data: TrainingSet, model: Fitted) -> DataFrame:
    """``(key, prediction)`` for every row that has all inputs and only known categories.

    Class predictions come back as the original labels.
    """
    good = _judged(df, data.prep).where("reason is null").drop("reason")
    ready = vectors(good.withColumn("__key", col(data.key)), data.prep).select("__key", "features")
    out = model.predict(ready)
    value = F.col("prediction")
    if data.task == CLASSIFICATION:
        value = F.array(*map(F.lit, data.classes))[F.col("prediction").cast("int")]
    return out.select(F.col("__key").alias(data.key), value.alias("prediction"))


def unseen_inputs(df: DataFrame, prep: Preparation) -> DataFrame:
    return unseen_categories(nan_to_null(df), prep.codes, prep.text)


# --- saving ------------------------------------------------------------------


def save_model(model: Fitted, data: TrainingSet, path: str) -> None:
    """Stages, code table and settings under one folder."""
    spark = data.train.sparkSession
    extra = {k: v for k, v in model.extra.items() if not isinstance(v, DataFrame | random_trees.Forest)}
    meta = {
        "name": model.name,
        "task": model.task,
        "weights": model.weights,
        "extra": extra,
        "target": data.target,
        "key": data.key,
        "classes": data.classes,
        "info": data.info,
        "features": data.prep.features,
        "text": data.prep.text,
        "dates": data.prep.dates,
        "scale": data.prep.scale,
        "stages": len(model.stages),
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if model.stages:
        PipelineModel(stages=model.stages).write().overwrite().save(f"{path}/stages")
    if data.prep.codes is not None:
        data.prep.codes.write.mode("overwrite").parquet(f"{path}/codes")
    if "train" in model.extra:
        model.extra["train"].write.mode("overwrite").parquet(f"{path}/train")
    if "forest" in model.extra:
        model.extra["forest"].table(spark).write.mode("overwrite").parquet(f"{path}/forest")


def load_model(spark: SparkSession, path: str) -> tuple[Fitted, TrainingSet]:
    """The model and what ``score`` needs; the training tables are not part of it."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    codes = spark.read.parquet(f"{path}/codes") if meta["text"] else None
    prep = Preparation(
        meta["features"], meta["text"], meta["dates"], codes, {c: tuple(v) for c, v in meta["scale"].items()}
    )
    stages = PipelineModel.load(f"{path}/stages").stages if meta["stages"] else []
    extra = dict(meta["extra"])
    if meta["name"] == "knn":
        extra["train"] = spark.read.parquet(f"{path}/train")
    if "trees" in extra:
        extra["forest"] = random_trees.Forest.of(spark.read.parquet(f"{path}/forest"), extra["trees"])
    model = Fitted(meta["name"], meta["task"], stages, meta["weights"], extra)
    empty = spark.createDataFrame([], T.StructType())
    return model, TrainingSet(meta["task"], meta["target"], meta["key"], prep, meta["classes"], empty, empty, meta["info"])
