"""Folds stratified by a continuous target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.operators import binning
from shardwright.operators.base import Strategy, names
from shardwright.operators.strategies.stratified import HierarchicalStratified


class RegressionStratified(Strategy):
    """The target is cut into bins, and the bins are the classes of hierarchical stratified folds.

    ``strategy``: quantile, uniform or kmeans. Without ``use_advanced`` the draws are plain: no
    bin is treated as rare.
    """

    min_samples_per_class = 1

    def __init__(self, key_cols: list[str], target_col: str, n_partitions: int = 5, random_state: int = 42, n_bins: int = 5, strategy: str = "quantile", encode: str = "ordinal", use_advanced: bool = True) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        if strategy not in ("quantile", "uniform", "kmeans"):
            raise ValueError(f"unknown binning strategy {strategy!r}; known: quantile, uniform, kmeans")
        if encode != "ordinal":
            raise ValueError("only ordinal bins can be classes")
        self.target_col, self.n_bins, self.strategy, self.use_advanced = target_col, n_bins, strategy, use_advanced

    def bin_column(self, data: DataFrame) -> Column:
        if self.strategy == "quantile":
            return binning.bin_by_edges(self.target_col, binning.quantile_edges(data, self.target_col, self.n_bins))
        make = binning.uniform_edges if self.strategy == "uniform" else binning.kmeans_edges
        return binning.digitize(self.target_col, make(data, self.target_col, self.n_bins))

    def binned(self, data: DataFrame) -> DataFrame:
        """Keys and ``bin``."""
        return data.select(*self.key_cols, self.bin_column(data).alias("bin"))

    def folds(self, data: DataFrame) -> DataFrame:
        rows = self.binned(data)
        few = self.min_samples_per_class if self.use_advanced else 0
        return HierarchicalStratified(self.key_cols, "bin", self.n_partitions, self.random_state, few).folds(rows)

    def assign(self, data: DataFrame) -> DataFrame:
        return self.folds(data).select(names(F.col("fold"), "chunk").alias("partition"), *self.key_cols)


class RegressionBinning(RegressionStratified):
    """The same with edges from a histogram rule, left-closed bins, and small bins merged."""

    def __init__(self, key_cols: list[str], target_col: str, n_partitions: int = 5, random_state: int = 42, bin_rule: str = "freedman_diaconis", min_samples_per_class: int = 1) -> None:
        super().__init__(key_cols, target_col, n_partitions, random_state)
        self.bin_rule, self.min_samples_per_class = bin_rule, min_samples_per_class

    def bin_column(self, data: DataFrame) -> Column:
        edges = binning.rule_edges(data, self.target_col, self.bin_rule, self.n_partitions)
        raw = binning.digitize(self.target_col, edges)
        counts = {r["b"]: r["count"] for r in data.select(raw.alias("b")).where("b IS NOT NULL").groupBy("b").count().collect()}
        merged = binning.merge_small_bins(counts, self.n_partitions * self.min_samples_per_class)
        if all(b == to for b, to in merged.items()):
            return raw
        mapping = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])
        return F.element_at(mapping, raw)
