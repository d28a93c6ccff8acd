"""Splits of time series: runs in time, windows of rows, and seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.functions.ordering import sliced_ranks
from shardwright.operators.base import Strategy, names


class TemporalSplit(Strategy):
    """Per series, rows in order of time (ties by key) go to ``split_i``.

    ``sequential``: cut at the whole parts of ``n * i / n_splits``. ``sliding_window``: windows
    of ``window_size`` rows that follow each other (by default a series' rows // n_splits); only
    whole windows, the first ``n_splits`` of them. ``seasonal``: by hour modulo ``period``.

    Time is cut at ``TIME_CELLS`` quantiles over all series, so a long series is ranked by many
    tasks.
    """

    TIME_CELLS = 256

    def __init__(self, key_cols: list[str], time_col: str = "timestamp", series_col: str = "series_id", n_splits: int = 4, method: str = "sequential", window_size: int | None = None, period: int = 24) -> None:
        super().__init__(key_cols, n_splits)
        if method not in ("sequential", "sliding_window", "seasonal"):
            raise ValueError(f"unknown temporal method {method!r}; known: sequential, sliding_window, seasonal")
        self.time_col, self.series_col, self.method = time_col, series_col, method
        self.window_size, self.period = window_size, period

    def splits(self, data: DataFrame) -> DataFrame:
        """Series, ``split`` and keys."""
        columns = [self.series_col, *[k for k in self.key_cols if k != self.series_col]]
        if self.method == "seasonal":
            return data.select(*columns, (F.hour(self.time_col) % self.period).alias("split"))
        shares = [i / self.TIME_CELLS for i in range(1, self.TIME_CELLS)]
        # Microseconds of the time, which sort as it does.
        at = F.unix_micros(F.col(self.time_col).cast("timestamp"))
        cuts = sorted(set(data.agg(F.percentile_approx(at, shares)).first()[0] or []))
        cell = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at)) if cuts else F.lit(0)
        rows = data.select(*columns, F.col(self.time_col).alias("_time"), F.when(at.isNull(), -1).otherwise(cell).alias("_cell"))
        rows = sliced_ranks(rows, [self.series_col], "_cell", ["_time", *self.key_cols])
        rows = rows.select(*columns, F.col("rank").alias("_at"), F.col("total").alias("_n"))
        k = self.n_partitions
        if self.method == "sequential":
            # Cuts in doubles, step first, as a linear spacing computes them.
            cuts = [F.floor(F.lit(float(i)) * (F.col("_n").cast("double") / F.lit(float(k)))) for i in range(1, k)]
            split = sum((F.when(c <= F.col("_at"), 1).otherwise(0) for c in cuts), F.lit(0))
            return rows.select(*columns, split.cast("int").alias("split"))
        width = F.lit(self.window_size) if self.window_size else F.floor(F.col("_n") / k)
        rows = rows.withColumn("_w", width.cast("long")).where("_w > 0").withColumn("split", F.floor(F.col("_at") / F.col("_w")).cast("int"))
        return rows.where((F.col("split") < k) & ((F.col("split") + 1) * F.col("_w") <= F.col("_n"))).select(*columns, "split")

    def assign(self, data: DataFrame) -> DataFrame:
        return self.splits(data).select(names(F.col("split"), "split").alias("partition"), self.series_col, *[k for k in self.key_cols if k != self.series_col])
