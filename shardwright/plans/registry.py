"""Strategies by name, and the choice of one for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shardwright.operators.base import Strategy
from shardwright.operators.strategies.balance import StratifiedBalanced
from shardwright.operators.strategies.clustering import FeatureClustering, TSNEClustering
from shardwright.operators.strategies.difficulty import DifficultySplit, UncertaintySplit
from shardwright.operators.strategies.random import RandomSplit
from shardwright.operators.strategies.regression import RegressionBinning, RegressionStratified
from shardwright.operators.strategies.stratified import HierarchicalStratified, MultilabelStratified, StratifiedKFold, TrainTestSplit
from shardwright.operators.strategies.temporal import TemporalSplit


def stratified(key_cols: list[str], label_col: str | list[str], **options) -> Strategy:
    """Hierarchical folds for one label, multilabel folds for a list of them."""
    if isinstance(label_col, str):
        options.pop("uniqueness_threshold", None)
        return HierarchicalStratified(key_cols, label_col, **{"n_partitions": 5, **options})
    return MultilabelStratified(key_cols, label_col, **options)


STRATEGIES: dict = {
    "random": RandomSplit,
    "random_split": RandomSplit,
    "stratified": stratified,
    "advanced_stratified": HierarchicalStratified,
    "hierarchical_stratified": HierarchicalStratified,
    "regression_stratified": RegressionStratified,
    "regression_binning": RegressionBinning,
    "temporal": TemporalSplit,
    "temporal_split": TemporalSplit,
    "feature_clustering": FeatureClustering,
    "tsne_clustering": TSNEClustering,
    "difficulty": DifficultySplit,
    "uncertainty": UncertaintySplit,
    "balance": StratifiedBalanced,
    "stratified_kfold": StratifiedKFold,
    "train_test": TrainTestSplit,
}


def register(name: str):
    """A decorator that adds a strategy under a name."""

    def add(made):
        STRATEGIES[name] = made
        return made

    return add


class SamplingStrategyFactory:
    """Creates strategies by name and applies them."""

    def get_available_strategies(self) -> list[str]:
        return sorted(STRATEGIES)

    def create_strategy(self, name: str, **options) -> Strategy:
        if name not in STRATEGIES:
            raise ValueError(f"unknown strategy {name!r}; known: {', '.join(self.get_available_strategies())}")
        return STRATEGIES[name](**options)

    def create_and_fit(self, name: str, data: DataFrame, strategy_kwargs: dict) -> tuple[Strategy, DataFrame]:
        """The strategy and its assignment of the rows of ``data``."""
        strategy = self.create_strategy(name, **strategy_kwargs)
        return strategy, strategy.assign(data)

    def fit_transform(self, name: str, data: DataFrame, strategy_kwargs: dict) -> DataFrame:
        """The rows of ``data`` with their partition."""
        return self.create_strategy(name, **strategy_kwargs).materialize(data)


class AdaptiveSampler:
    """Chooses a strategy by the table's columns; does not fit it."""

    def auto_select_strategy(self, data: DataFrame, key_cols: list[str], target: str | None = None) -> Strategy:
        """A ``timestamp`` column asks for time; arrays and tables with a target for k-means; others for density clusters."""
        if "timestamp" in data.columns:
            return TemporalSplit(key_cols, series_col="series_id" if "series_id" in data.columns else key_cols[0])
        if target is not None or any(kind.startswith("array") for _, kind in data.dtypes):
            return FeatureClustering(key_cols, method="kmeans")
        return FeatureClustering(key_cols, method="dbscan")
