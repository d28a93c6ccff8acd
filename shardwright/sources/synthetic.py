"""Generated tables; the same seed gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ids(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(0, rows, 1, 8)


def tabular(spark: SparkSession, rows: int = 1000, features: int = 20, task: str = "classification", seed: int = 42) -> DataFrame:
    """``id, feature_0.., y``: normal features, and a target that depends on the first three."""
    data = _ids(spark, rows).select("id", *[F.randn(seed + i).alias(f"feature_{i}") for i in range(features)])
    signal = F.col("feature_0") + 0.5 * F.col(f"feature_{min(1, features - 1)}") - F.col(f"feature_{min(2, features - 1)}")
    noisy = signal + 0.1 * F.randn(seed + features)
    return data.withColumn("y", (noisy > 0).cast("int") if task == "classification" else noisy * 10)


def time_series(spark: SparkSession, series: int = 10, hours: int = 1000, seed: int = 42) -> DataFrame:
    """``series_id, timestamp, value, feature_1, feature_2``: a daily wave with noise, by the hour."""
    grid = spark.range(series).withColumnRenamed("id", "series_id").withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    wave = F.sin(F.col("_h") * F.lit(2 * 3.141592653589793 / 24)) + 0.1 * F.randn(seed)
    stamp = F.timestamp_add("HOUR", F.col("_h"), F.lit("2023-01-01").cast("timestamp_ntz"))
    return grid.select("series_id", stamp.alias("timestamp"), wave.alias("value"), F.randn(seed + 1).alias("feature_1"), F.rand(seed + 2).alias("feature_2"))


def two_normals(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """``id, feature_1 ~ N(5, 2), feature_2 ~ N(-3, 1.5), target`` of a coin."""
    return _ids(spark, rows).select(
        "id", (5 + 2 * F.randn(seed)).alias("feature_1"), (-3 + 1.5 * F.randn(seed + 1)).alias("feature_2"), (F.rand(seed + 2) < 0.5).cast("int").alias("target")
    )


def imbalanced(spark: SparkSession, rows: int = 1000, majority: float = 0.9, seed: int = 42) -> DataFrame:
    """``id, feature_1, feature_2, target``: two shifted clouds, the first with the share ``majority``."""
    data = _ids(spark, rows).select("id", (F.rand(seed) >= majority).cast("int").alias("target"))
    return data.select("id", *[(2.0 * F.col("target") + F.randn(seed + i)).alias(f"feature_{i}") for i in (1, 2)], "target")


def noisy_logistic(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """``id, feature_1 ~ N(0, 1), feature_2 ~ N(0, 0.5), target``: sigmoid(2 f1 - f2 + 0.2 noise) above one half."""
    data = _ids(spark, rows).select("id", F.randn(seed).alias("feature_1"), (0.5 * F.randn(seed + 1)).alias("feature_2"), F.randn(seed + 2).alias("_e"))
    p = 1 / (1 + F.exp(-(2 * F.col("feature_1") - F.col("feature_2") + 0.2 * F.col("_e"))))
    return data.withColumn("target", (p > 0.5).cast("int")).drop("_e")
