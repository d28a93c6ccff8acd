"""Nearest centroid: a classifier of closed form, for scores that any engine can repeat."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NearestCentroid:
    """``fit`` takes ``label`` (an index) and ``features`` (a vector); the mean of every class is kept."""

    def fit(self, rows: DataFrame) -> NearestCentroidModel:
        points = rows.select("label", F.posexplode(vector_to_array("features")).alias("i", "x"))
        means = points.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label")
        found = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")).collect()
        return NearestCentroidModel({int(r["label"]): list(r["centre"]) for r in found})


class NearestCentroidModel:
    """``transform`` adds ``probability``, by class index the share of exp(-d2) over all classes, and ``prediction``.

    ``d2`` is the squared distance to a class; a class that was not learnt has probability 0, and
    the first of equally near classes is predicted.
    """

    def __init__(self, centres: dict[int, list[float]]) -> None:
        if not centres:
            raise ValueError("there is no class to learn")
        self.centres = centres

    def transform(self, rows: DataFrame) -> DataFrame:
        x = vector_to_array("features")

        def d2(centre: list[float]):
            gaps = F.zip_with("_x", F.array(*[F.lit(c) for c in centre]), lambda a, b: (a - b) * (a - b))
            return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)

        far = [d2(self.centres[c]) if c in self.centres else F.lit(None).cast("double") for c in range(max(self.centres) + 1)]
        found = rows.withColumn("_x", x).withColumn("_d2", F.array(*far)).withColumn("_least", F.array_min("_d2"))
        found = found.withColumn("_near", F.transform("_d2", lambda d: F.coalesce(F.exp(F.col("_least") - d), F.lit(0.0))))
        total = F.aggregate("_near", F.lit(0.0), lambda s, v: s + v)
        found = found.withColumn("probability", F.transform("_near", lambda e: e / total))
        best = F.array_position(F.col("_d2"), F.col("_least")) - 1
        return found.withColumn("prediction", best.cast("double")).drop("_x", "_d2", "_least", "_near")
