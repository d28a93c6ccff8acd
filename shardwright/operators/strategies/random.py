"""Random disjoint split and train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.functions.ordering import ntile_of, order_key, ranks
from shardwright.operators.base import Strategy, names


class RandomSplit(Strategy):
    """Disjoint, covering parts of near-equal size in seeded random order: ``partition_0`` and on."""

    def assign(self, data: DataFrame) -> DataFrame:
        rows = data.select(*self.key_cols).withColumn("_key", order_key(self.random_state, self.key_cols))
        ranked = ranks(rows, [], "_key", self.key_cols, digits=3)
        part = ntile_of(F.col("rank"), F.col("total"), self.n_partitions)
        return ranked.select(names(part, "partition").alias("partition"), *self.key_cols)
