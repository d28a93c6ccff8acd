"""Numeric features: which columns, missing values, scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(data: DataFrame, without: list[str] = ()) -> list[str]:
    return [c for c, kind in data.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c not in without]


def mean_impute(data: DataFrame, columns: list[str]) -> DataFrame:
    """Null and NaN become the column's mean (0 if it has no value)."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    means = data.agg(*[F.avg(v).alias(c) for c, v in known.items()]).first().asDict() if columns else {}
    return data.withColumns({c: F.coalesce(v, F.lit(means[c] if means[c] is not None else 0.0)) for c, v in known.items()})


def zscore(data: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is 0)."""
    stats = data.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict() if columns else {}
    return data.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def label_encode(data: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Adds the place of the label among the sorted distinct labels, from 0; a null label stays null."""
    from pyspark.sql import Window

    found = data.select(label).where(F.col(label).isNotNull()).distinct()
    codes = found.select(F.col(label).alias("_label"), (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(label)) - 1).cast("long").alias(out))
    return data.join(codes, data[label] == codes["_label"], "left").drop("_label")
