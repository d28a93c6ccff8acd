"""Bins of a numeric column: edges from small aggregates, labels as column expressions.

Null values get a null bin. Edges come to the driver; there are as many as bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions.ordering import exact_quantiles

#: Bins that a histogram rule may ask for; their edges come to the driver and into the plan.
MOST_BINS = 10_000


def quantile_edges(data: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct edges at the exact quantiles 0, 1/bins, ..., 1 (linear interpolation)."""
    shares = [i / bins for i in range(bins + 1)]
    return sorted(set(exact_quantiles(data, value, shares)))


def uniform_edges(data: DataFrame, value: str, bins: int) -> list[float]:
    """Edges of ``bins`` equally wide bins from the least to the largest value."""
    low, high = data.agg(F.min(value), F.max(value)).first()
    if low is None:
        return []
    low, high = float(low), float(high)
    return [low + (high - low) * i / bins for i in range(bins)] + [high] if high > low else [low, low + 1e-9]


def kmeans_edges(data: DataFrame, value: str, bins: int, seed: int = 42) -> list[float]:
    """Edges halfway between the sorted centres of one-dimensional k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    low, high = data.agg(F.min(value), F.max(value)).first()
    if low is None:
        return []
    vectors = VectorAssembler(inputCols=[value], outputCol="_v", handleInvalid="skip").transform(data.select(F.col(value).cast("double").alias(value)))
    centres = sorted(float(c[0]) for c in KMeans(k=bins, seed=seed, featuresCol="_v").fit(vectors).clusterCenters())
    return [float(low), *[(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)], float(high)]


def rule_edges(data: DataFrame, value: str, rule: str, n_partitions: int = 5) -> list[float]:
    """Edges by a histogram rule.

    ``freedman_diaconis``: width 2 IQR / cbrt(n); ``scott``: 3.5 sd / cbrt(n); ``quantile``:
    between 2 and ``n_partitions`` quantile bins, no more than distinct values. A constant
    column has one bin of width 1e-9; a width that is zero, or larger than the range, gives one
    bin. More than ``MOST_BINS`` bins are refused.
    """
    if rule not in ("freedman_diaconis", "scott", "quantile"):
        raise ValueError(f"unknown bin rule {rule!r}; known: freedman_diaconis, scott, quantile")
    n, low, high, sd = data.agg(F.count(value), F.min(value), F.max(value), F.stddev_samp(value)).first()
    if not n:
        return []
    low, high = float(low), float(high)
    if low == high:
        return [low, low + 1e-9]
    if rule == "quantile":
        distinct = data.select(value).where(F.col(value).isNotNull()).distinct().count()
        return quantile_edges(data, value, max(2, min(distinct, n_partitions)))
    if rule == "freedman_diaconis":
        quartiles = exact_quantiles(data, value, [0.25, 0.75])
        width = 2 * (quartiles[1] - quartiles[0]) / n ** (1 / 3)
    else:
        width = 3.5 * (sd or 0.0) / n ** (1 / 3)
    if not width or not math.isfinite(width) or width <= 0:
        return [low, high]
    bins = max(1, math.ceil((high - low) / width))
    if bins > MOST_BINS:
        raise ValueError(f"{rule} asks for {bins} bins of {value!r}, more than {MOST_BINS}; an outlier may have stretched the range")
    return [low + (high - low) * i / bins for i in range(bins)] + [high]


def _passed(value: str, edges: list[float], strictly: bool) -> Column:
    """How many edges lie below the value, found by halving, so that many edges cost little."""
    if not edges:
        return F.lit(0)
    column = F.col(value)

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        above = column > edges[middle] if strictly else column >= edges[middle]
        return F.when(above, halve(middle + 1, high)).otherwise(halve(low, middle))

    return halve(0, len(edges))


def bin_by_edges(value: str, edges: list[float]) -> Column:
    """Right-closed bins: the number of edges below the value, less one; the least value is in bin 0."""
    return F.when(F.col(value).isNotNull(), F.greatest(_passed(value, edges, True) - 1, F.lit(0)).cast("int"))


def digitize(value: str, edges: list[float]) -> Column:
    """Left-closed bins: how many interior edges do not exceed the value."""
    return F.when(F.col(value).isNotNull(), _passed(value, edges[1:-1], False).cast("int"))


def merge_small_bins(counts: dict[int, int], min_samples: int) -> dict[int, int]:
    """Maps each bin to the bin it is merged into, numbered from 0 without gaps.

    From left to right, a bin with fewer than ``min_samples`` rows joins its smaller neighbour,
    the left one on a tie; the joined bin is looked at again.
    """
    groups = [[b] for b in sorted(counts)]
    sizes = [counts[b] for b in sorted(counts)]
    at = 0
    while at < len(groups) and len(groups) > 1:
        if sizes[at] >= min_samples:
            at += 1
            continue
        left = at > 0 and (at + 1 == len(groups) or sizes[at - 1] <= sizes[at + 1])
        into = at - 1 if left else at + 1
        first, second = sorted((at, into))
        groups[first] += groups.pop(second)
        sizes[first] += sizes.pop(second)
        at = first
    return {b: i for i, group in enumerate(groups) for b in group}
