"""Stratified folds whose classes are balanced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.operators.base import Strategy
from shardwright.operators.graph import checkpointed
from shardwright.operators.resample import METHODS, Balancer
from shardwright.operators.strategies.stratified import StratifiedKFold


class StratifiedBalanced(Strategy):
    """Disjoint stratified folds, each resampled by ``balance_method`` (None: left as they are).

    ``features_col`` is an array of doubles, needed by all methods but ``rus``. ``materialize``
    gives partition, key, label, features and ``synthetic``; synthetic rows have a null key, so
    ``assign`` lists the rows of the table only.
    """

    def __init__(self, key_cols: list[str], label_col: str, n_partitions: int = 5, random_state: int = 42, features_col: str = "features", balance_method: str | None = None, balancer_kwargs: dict | None = None) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        if balance_method is not None and balance_method not in METHODS:
            raise ValueError(f"unknown balance method {balance_method!r}; known: {', '.join(METHODS)}")
        if len(key_cols) != 1:
            raise ValueError("balancing needs a single key column")
        self.label_col, self.features_col = label_col, features_col
        self.balance_method, self.balancer_kwargs = balance_method, balancer_kwargs or {}

    def materialize(self, data: DataFrame) -> DataFrame:
        key = self.key_cols[0]
        folds = StratifiedKFold(self.key_cols, self.label_col, self.n_partitions, self.random_state).assign(data)
        folds = folds.select("partition", F.col(key).alias("_key"))
        features = F.col(self.features_col) if self.features_col in data.columns else F.array().cast("array<double>")
        rows = data.select(key, self.label_col, features.alias(self.features_col))
        rows = rows.join(folds, rows[key].eqNullSafe(F.col("_key"))).select("partition", key, self.label_col, self.features_col)
        if self.balance_method is None:
            return rows.withColumn("synthetic", F.lit(False))
        rows = checkpointed(rows)
        balancer = Balancer(["partition"], key, self.label_col, self.features_col, self.random_state)
        return METHODS[self.balance_method](balancer, rows, **self.balancer_kwargs)

    fit_transform = materialize

    def assign(self, data: DataFrame) -> DataFrame:
        return self.materialize(data).where(~F.col("synthetic")).select("partition", *self.key_cols)
