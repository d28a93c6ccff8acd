"""Metrics of predictions, each one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """``accuracy, f1_macro, f1_weighted``; classes are all labels and predictions, 0/0 is 0."""
    cells = rows.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.col("y").alias("c"), "n", F.lit(0).alias("as_p"), (F.col("y") == F.col("p")).alias("hit")).unionByName(
        cells.select(F.col("p").alias("c"), "n", F.lit(1).alias("as_p"), F.lit(False).alias("hit"))
    )
    per = sides.groupBy("c").agg(
        F.sum(F.when(F.col("as_p") == 0, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("as_p") == 1, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
    )
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return per.withColumn("f1", f1).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def log_loss(rows: DataFrame, probability: str, epsilon: float = 1e-15) -> DataFrame:
    """Mean negative logarithm of the probability given to the true class."""
    p = F.least(F.greatest(F.col(probability), F.lit(epsilon)), F.lit(1 - epsilon))
    return rows.agg((-F.avg(F.log(p))).alias("log_loss"))


def regression_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """``mse, rmse, r2``; r2 is null for a constant target."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    found = rows.agg(F.avg((y - p) * (y - p)).alias("mse"), F.sum((y - p) * (y - p)).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return found.select("mse", F.sqrt("mse").alias("rmse"), F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"))
