"""Reports on classes, folds and partitions: all are small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_distribution(data: DataFrame, label: str, k: int) -> DataFrame:
    """One row: ``n_classes, total, min_count, max_count, small_classes`` (classes with fewer than ``k`` rows)."""
    counts = data.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.min("n").alias("min_count"),
        F.max("n").alias("max_count"),
        F.count(F.when(F.col("n") < k, 1)).alias("small_classes"),
    )


def fold_summary(assigned: DataFrame, label: str) -> DataFrame:
    """``partition, label, n``."""
    return assigned.groupBy("partition", label).agg(F.count("*").alias("n"))


def bin_distribution(assigned: DataFrame, bin_col: str = "bin") -> DataFrame:
    """``partition, bin, n, share``: how a partition's rows lie over the bins of the target."""
    counts = assigned.groupBy("partition", bin_col).agg(F.count("*").alias("n"))
    sizes = assigned.groupBy(F.col("partition").alias("_p")).agg(F.count("*").alias("_n"))
    joined = counts.join(F.broadcast(sizes), F.col("partition").eqNullSafe(F.col("_p")))
    return joined.select("partition", bin_col, "n", (F.col("n") / F.col("_n")).alias("share"))


def fold_validation(folds: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Per fold, its distinct classes against those of the table."""
    return folds.groupBy("fold").agg(F.count_distinct(label).alias("n_classes")).withColumn("complete", F.col("n_classes") == n_classes)


def fold_statistics(folds: DataFrame, label: str) -> DataFrame:
    """``fold, test_size, test_n_classes, test_min_class, test_max_class``."""
    counts = folds.groupBy("fold", label).agg(F.count("*").alias("n"))
    return counts.groupBy("fold").agg(
        F.sum("n").alias("test_size"), F.count("*").alias("test_n_classes"), F.min("n").alias("test_min_class"), F.max("n").alias("test_max_class")
    )


def partition_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per partition: mean, sample standard deviation and variance of each column."""
    stats = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("var", F.var_samp))]
    return rows.groupBy("partition").agg(F.count("*").alias("n"), *stats)


def confusion(rows: DataFrame, label: str, prediction: str, by: str | None = "partition") -> DataFrame:
    """Counts of (label, prediction), per partition if ``by`` is given."""
    return rows.groupBy(*([by] if by else []), label, prediction).agg(F.count("*").alias("n"))


def error_rates(rows: DataFrame, label: str, prediction: str, by: str = "partition") -> DataFrame:
    """Per partition ``errors, total, error_pct``."""
    wrong = F.when(F.col(label).eqNullSafe(F.col(prediction)), 0).otherwise(1)
    found = rows.groupBy(by).agg(F.sum(wrong).alias("errors"), F.count("*").alias("total"))
    return found.withColumn("error_pct", 100.0 * F.col("errors") / F.col("total"))


def score_report(rows: DataFrame, score: str, label: str, prediction: str, by: str = "partition") -> DataFrame:
    """Per partition: mean score and error rate."""
    wrong = F.when(F.col(label).eqNullSafe(F.col(prediction)), 0.0).otherwise(1.0)
    return rows.groupBy(by).agg(F.avg(score).alias("mean_score"), F.avg(wrong).alias("error_rate"), F.count("*").alias("n"))
