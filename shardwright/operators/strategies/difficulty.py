"""Splits by how hard rows are for a model that has not seen them, or how unsure it is."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions.ordering import ntile_of, value_ranks
from shardwright.operators.base import Strategy, names
from shardwright.operators.graph import checkpointed
from shardwright.operators.strategies.stratified import StratifiedKFold


def entropy(probabilities: Column) -> Column:
    """Entropy over its maximum: 0 for a sure vote, about 1 for an even one; 0 with one class."""
    size = F.size(probabilities)
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a - x * F.log(x + F.lit(1e-8)))
    return F.when(size > 1, total / F.log(size.cast("double"))).otherwise(0.0)


def is_classification(data: DataFrame, label: str) -> bool:
    """True for a string label, or one with fewer distinct values than a tenth of the rows."""
    kind = dict(data.dtypes)[label]
    if kind in ("string", "boolean"):
        return True
    distinct, total = data.agg(F.count_distinct(label), F.count("*")).first()
    return distinct < 0.1 * total


def split_by_score(scored: DataFrame, keys: list[str], score: str, n_partitions: int, threshold: float | None, hard: str, easy: str, prefix: str) -> DataFrame:
    """Two named sides of a threshold if there is one and two parts are asked for; else equal parts in ascending order."""
    if n_partitions == 2 and threshold is not None:
        return scored.select(F.when(F.col(score) > threshold, hard).otherwise(easy).alias("partition"), *keys)
    ranked = value_ranks(scored.select(score, *keys), score, keys)
    return ranked.select(names(ntile_of(F.col("rank"), F.col("total"), n_partitions), prefix).alias("partition"), *keys)


class DifficultySplit(Strategy):
    """Rows by out-of-fold error of a model (five folds): ``hard`` and ``easy``, or ``chunk_i`` by rank.

    The score is one less the probability of the true class, 0 or 1 without probabilities, and
    for a numeric target the absolute error over the largest one. ``estimator`` is an untrained
    ``pyspark.ml`` model over the columns ``features`` and ``label``; by default a random forest.
    A regressor or classifier of ``pyspark.ml`` settles what the target is; else the label does.
    """

    hard, easy, prefix = "hard", "easy", "chunk"
    FITS_AT_ONCE = 4

    def __init__(self, key_cols: list[str], label_col: str, feature_cols: list[str], n_partitions: int = 2, random_state: int = 42, threshold: float | None = None, estimator=None, cv: int = 5) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        self.label_col, self.feature_cols, self.threshold, self.estimator, self.cv = label_col, list(feature_cols), threshold, estimator, cv

    def classifies(self, data: DataFrame) -> bool:
        from pyspark.ml.classification import Classifier
        from pyspark.ml.regression import Regressor

        if isinstance(self.estimator, (Classifier, Regressor)):
            return isinstance(self.estimator, Classifier)
        return is_classification(data, self.label_col)

    def out_of_fold(self, data: DataFrame, classify: bool) -> DataFrame:
        """Keys, ``label`` (index of the sorted class, or the number), ``prediction`` and, if there are any, ``probability``.

        A few folds are fitted at a time on one stored table; what the models say of their own
        fold is stored too, so that ranking does not run them again.
        """
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.regression import RandomForestRegressor

        rows = data.where(F.col(self.label_col).isNotNull())
        inputs = [f"_feature_{i}" for i in range(len(self.feature_cols))]
        numeric = [F.col(c).cast("double").alias(f) for c, f in zip(self.feature_cols, inputs, strict=True)]
        if classify:
            folds = StratifiedKFold(self.key_cols, self.label_col, self.cv, self.random_state).folds(rows).select("fold", *self.key_cols)
        else:
            ranked = value_ranks(rows.select(*self.key_cols), self.key_cols[0], self.key_cols)
            folds = ranked.select(ntile_of(F.col("rank"), F.col("total"), self.cv).alias("fold"), *self.key_cols)
        rows = rows.select(*self.key_cols, F.col(self.label_col).alias("_y"), *numeric).join(folds, self.key_cols)
        if classify:
            rows = rows.withColumn("_y", F.col("_y").cast("string"))
            rows = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows)
        else:
            rows = rows.withColumn("label", F.col("_y").cast("double"))
        filled = Imputer(inputCols=inputs, outputCols=inputs).fit(rows).transform(rows)
        ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(filled).select(*self.key_cols, "fold", "label", "features")
        ready = checkpointed(ready)
        model = self.estimator or (RandomForestClassifier if classify else RandomForestRegressor)(numTrees=10, maxDepth=5, seed=self.random_state)
        with ThreadPoolExecutor(min(self.cv, self.FITS_AT_ONCE)) as pool:
            fitted = list(pool.map(lambda fold: model.fit(ready.where(F.col("fold") != fold)), range(self.cv)))
        found = None
        for fold, one in enumerate(fitted):
            out = one.transform(ready.where(F.col("fold") == fold))
            columns = [*self.key_cols, "label", "prediction"]
            if classify and "probability" in out.columns:
                vector = dict(out.dtypes)["probability"] == "vector"
                columns.append((vector_to_array("probability") if vector else F.col("probability")).alias("probability"))
            out = out.select(*columns)
            found = out if found is None else found.unionByName(out)
        return checkpointed(found)

    def scores(self, data: DataFrame) -> DataFrame:
        """Keys and ``score``."""
        classify = self.classifies(data)
        found = self.out_of_fold(data, classify)
        if classify and "probability" in found.columns:
            score = 1 - F.coalesce(F.get("probability", F.col("label").cast("int")), F.lit(0.0))
        elif classify:
            score = (F.col("prediction") != F.col("label")).cast("double")
        else:
            error = F.abs(F.col("label") - F.col("prediction"))
            largest = found.agg(F.max(error)).first()[0] or 0.0
            score = error / (largest + 1e-8)
        return found.select(*self.key_cols, score.alias("score"))

    def assign(self, data: DataFrame) -> DataFrame:
        return split_by_score(self.scores(data), self.key_cols, "score", self.n_partitions, self.threshold, self.hard, self.easy, self.prefix)


class UncertaintySplit(DifficultySplit):
    """Rows by the entropy of out-of-fold class probabilities: ``high_uncertainty`` and ``low_uncertainty``, or levels."""

    hard, easy, prefix = "high_uncertainty", "low_uncertainty", "uncertainty_level"

    def scores(self, data: DataFrame) -> DataFrame:
        if not self.classifies(data):
            raise ValueError("uncertainty needs a class label")
        found = self.out_of_fold(data, True)
        if "probability" not in found.columns:
            raise ValueError("uncertainty needs a model with probabilities")
        return found.select(*self.key_cols, entropy(F.col("probability")).alias("score"))
