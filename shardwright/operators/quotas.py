"""How many rows of each class a stratified draw takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw_quotas(counts: DataFrame, label: str, k: int) -> DataFrame:
    """``label, n, quota`` for a draw of one k-th of the rows, given ``label, n`` per class.

    The draw has ceil(n / k) rows. The rest is shared over classes by largest remainder (ties by
    label) and the quota is what a class has left, so quotas add up exactly. One row per class
    passes here.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    rest = total - F.ceil(total / k)
    exact = rest * F.col("n") / total
    shared = counts.withColumn("_floor", F.floor(exact)).withColumn("_part", F.round(exact - F.floor(exact), 9)).withColumn("_rest", rest)
    order = everything.orderBy(F.desc("_part"), F.col(label).asc_nulls_first())
    short = F.col("_rest") - F.sum("_floor").over(everything)
    kept = F.col("_floor") + F.when(F.row_number().over(order) <= short, 1).otherwise(0)
    return shared.select(label, "n", (F.col("n") - kept).cast("long").alias("quota"))
