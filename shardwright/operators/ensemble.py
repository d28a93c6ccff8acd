"""One model per partition, and their votes."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.operators.graph import checkpointed

log = logging.getLogger(__name__)


def hard_vote(predictions: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """The most frequent prediction for each key; the smallest one on a tie."""
    counts = predictions.groupBy(*keys, prediction).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(prediction, F.struct(-F.col("_n"), F.col(prediction))).alias(prediction))


def mean_vote(predictions: DataFrame, keys: list[str], prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    """The mean prediction for each key, weighted if a weight column is named."""
    if weight is None:
        return predictions.groupBy(*keys).agg(F.avg(prediction).alias(prediction))
    return predictions.groupBy(*keys).agg((F.sum(F.col(prediction) * F.col(weight)) / F.sum(weight)).alias(prediction))


def soft_vote(predictions: DataFrame, keys: list[str], classes: int, probability: str = "probability", weight: str | None = None) -> DataFrame:
    """The class with the largest mean probability for each key (the first on a tie), and the means."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = [(F.sum(F.get(probability, F.lit(c)) * w) / F.sum(w)).alias(f"_p{c}") for c in range(classes)]
    found = predictions.groupBy(*keys).agg(*means).withColumn(probability, F.array(*[f"_p{c}" for c in range(classes)]))
    return found.select(*keys, (F.array_position(probability, F.array_max(probability)) - 1).cast("int").alias("prediction"), probability)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


class PartitionEnsemble:
    """Trains a model on each partition and joins their predictions.

    ``make_estimator`` gives an untrained ``pyspark.ml`` estimator. A few partitions are learnt
    from at a time. One with a single class (or, for regression, a single row) is skipped with a
    warning; other failures are raised. ``weight_key`` names the metric whose value weighs a
    model's vote (``evaluate`` gives the metrics of a model on its partition); by default all
    weigh the same.
    """

    FITS_AT_ONCE = 4

    def __init__(self, make_estimator: Callable, problem: str = "classification", weight_key: str | None = None, evaluate: Callable | None = None, label_col: str = "label") -> None:
        if problem not in ("classification", "regression"):
            raise ValueError("problem is classification or regression")
        self.make_estimator, self.problem, self.weight_key, self.evaluate, self.label_col = make_estimator, problem, weight_key, evaluate, label_col
        self.models: dict = {}
        self.metrics: dict = {}

    def fit(self, partitioned: DataFrame) -> PartitionEnsemble:
        partitioned = checkpointed(partitioned)
        many = F.count_distinct(self.label_col) if self.problem == "classification" else F.count(self.label_col)
        sizes = {r["partition"]: r["n"] for r in partitioned.groupBy("partition").agg(many.alias("n")).collect()}

        def train(name: str) -> tuple:
            rows = partitioned.where(F.col("partition") == name)
            model = self.make_estimator().fit(rows)
            return model, self.evaluate(model, rows) if self.evaluate else {}

        named = [name for name in sorted(sizes) if sizes[name] > 1]
        for name in sorted(set(sizes) - set(named)):
            log.warning("partition %s is skipped: there is nothing to tell apart", name)
        with ThreadPoolExecutor(self.FITS_AT_ONCE) as pool:
            for name, (model, metrics) in zip(named, pool.map(train, named), strict=True):
                self.models[name], self.metrics[name] = model, metrics
        if not self.models:
            raise ValueError("no partition could be learnt from")
        return self

    def predictions(self, data: DataFrame, keys: list[str]) -> DataFrame:
        """One row per model and key, with the model's weight."""
        from pyspark.ml.functions import vector_to_array

        found = None
        for name, model in self.models.items():
            out = model.transform(data)
            weight = float(self.metrics[name].get(self.weight_key, 0.5)) if self.weight_key else 1.0
            columns = [*keys, F.lit(name).alias("partition"), "prediction", F.lit(weight).alias("weight")]
            if "probability" in out.columns:
                columns.append(vector_to_array("probability").alias("probability"))
            out = out.select(*columns)
            found = out if found is None else found.unionByName(out)
        return found

    def predict(self, data: DataFrame, keys: list[str], voting: str = "hard") -> DataFrame:
        votes = self.predictions(data, keys)
        if self.problem == "regression":
            return mean_vote(votes, keys, weight="weight" if voting == "weighted" else None)
        if voting == "hard":
            return hard_vote(votes, keys)
        classes = votes.agg(F.max(F.size("probability"))).first()[0]
        return soft_vote(votes, keys, classes, weight="weight")
