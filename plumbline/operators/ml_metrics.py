"""Model quality from predictions, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.schema import col


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and class-weighted precision, recall and F1 in percent.

    A class that is never predicted has precision 0.  Only the confusion table is
    shuffled, whatever the number of rows.
    """
    hit = F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"), F.col("n").alias("actual"), zero.alias("predicted"), F.when(hit, F.col("n")).otherwise(0).alias("hits")
        ),
        F.struct(F.col("prediction").alias("cls"), zero.alias("actual"), F.col("n").alias("predicted"), zero.alias("hits")),
    )
    per_class = (
        confusion(df, label, prediction)
        .select(F.inline(sides))
        .groupBy("cls")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("actual", "predicted", "hits")])
    )
    p = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    total = F.sum("actual")
    return per_class.agg(
        F.round(F.try_divide(F.sum("hits"), total) * 100, 2).alias("accuracy"),
        F.round(F.try_divide(F.sum(p * F.col("actual")), total) * 100, 2).alias("precision"),
        F.round(F.try_divide(F.sum(r * F.col("actual")), total) * 100, 2).alias("recall"),
        F.round(F.try_divide(F.sum(f1 * F.col("actual")), total) * 100, 2).alias("f1"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R squared in percent, and MAE, RMSE and MSE."""
    y, e = col(label).cast("double"), col(label) - col(prediction)
    mse = F.avg(e * e)
    return df.agg(
        F.round((1 - F.try_divide(mse, F.var_pop(y))) * 100, 2).alias("r2"),
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(mse), 4).alias("rmse"),
        F.round(mse, 4).alias("mse"),
    )
