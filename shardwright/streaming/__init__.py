"""Stateless assignment of rows of a stream, with figures frozen beforehand.

Only what looks at one row at a time works on a stream: a share of the hash order, the hour, and
edges or models fitted on a table. Ranks and quotas need the whole table and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.functions.ordering import order_key, uniform
from shardwright.operators.binning import bin_by_edges
from shardwright.operators.base import names


def hash_partitions(stream: DataFrame, key_cols: list[str], n_partitions: int, seed: int = 42) -> DataFrame:
    """``partition_i`` by seeded hash: each part gets about its share, whatever else arrives."""
    part = F.floor(uniform(order_key(seed, key_cols)) * n_partitions).cast("int")
    return stream.withColumn("partition", names(part, "partition"))


def hash_split(stream: DataFrame, key_cols: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``train`` or ``test`` by seeded hash."""
    return stream.withColumn("partition", F.when(uniform(order_key(seed, key_cols)) < test_share, "test").otherwise("train"))


def seasonal(stream: DataFrame, time_col: str, period: int = 24) -> DataFrame:
    """``split_i`` by the hour."""
    return stream.withColumn("partition", names(F.hour(time_col) % period, "split"))


def frozen_bins(stream: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``bin`` by edges taken from a table before."""
    return stream.withColumn("bin", bin_by_edges(value, edges))


def fitted_clusters(stream: DataFrame, model, prefix: str = "chunk") -> DataFrame:
    """``chunk_i`` by a fitted ``pyspark.ml`` clustering model."""
    return model.transform(stream).withColumn("partition", names(F.col(model.getPredictionCol()), prefix))
