"""Stratified folds: disjoint k-fold, independent draws with rare classes in every fold, multilabel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.functions.ordering import order_key, ranks, uniform
from shardwright.operators.base import Strategy, names
from shardwright.operators.quotas import draw_quotas


class StratifiedKFold(Strategy):
    """Disjoint folds: rows lined up by class, then seeded order, are dealt to the folds in turn."""

    prefix = "partition"

    def __init__(self, key_cols: list[str], label_col: str, n_partitions: int = 5, random_state: int = 42, shuffle: bool = True) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        self.label_col, self.shuffle = label_col, shuffle

    def folds(self, data: DataFrame) -> DataFrame:
        """``fold``, the label and the keys."""
        rows = data.select(self.label_col, *[k for k in self.key_cols if k != self.label_col])
        rows = rows.withColumn("_key", order_key(self.random_state, self.key_cols))
        ranked = ranks(rows, [self.label_col], "_key", self.key_cols)
        counts = rows.groupBy(self.label_col).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(F.lit(1)).orderBy(F.col(self.label_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(F.col(self.label_col).alias("_label"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
        joined = ranked.join(offsets, F.col(self.label_col).eqNullSafe(F.col("_label")))
        fold = ((F.col("_offset") + F.col("rank")) % self.n_partitions).cast("int")
        return joined.select(fold.alias("fold"), *rows.columns[:-1])

    def assign(self, data: DataFrame) -> DataFrame:
        return self.folds(data).select(names(F.col("fold"), self.prefix).alias("partition"), *self.key_cols)


class HierarchicalStratified(Strategy):
    """Folds that are independent stratified draws of one k-th each; rare classes are in all of them.

    A class is rare with fewer than ``n_partitions * min_samples_per_class`` rows. Folds overlap
    and need not cover the table.
    """

    def __init__(self, key_cols: list[str], label_col: str, n_partitions: int = 100, random_state: int = 42, min_samples_per_class: int = 2) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        self.label_col, self.min_samples_per_class = label_col, min_samples_per_class

    def class_table(self, data: DataFrame) -> DataFrame:
        """``label, n, is_rare``."""
        counts = data.groupBy(self.label_col).agg(F.count("*").alias("n"))
        return counts.withColumn("is_rare", F.col("n") < self.n_partitions * self.min_samples_per_class)

    def folds(self, data: DataFrame) -> DataFrame:
        """``fold``, the label and the keys."""
        label, k = self.label_col, self.n_partitions
        if k < 2:
            raise ValueError("independent draws need at least 2 partitions")
        rows = data.select(label, *[c for c in self.key_cols if c != label])
        classes = self.class_table(rows)
        quotas = draw_quotas(classes.where(~F.col("is_rare")).drop("is_rare"), label, k)
        n_classes, n_rows = quotas.agg(F.count("*"), F.sum("n")).first()
        if n_classes and -(-n_rows // k) < n_classes:
            raise ValueError(f"a draw of {-(-n_rows // k)} rows cannot hold {n_classes} classes")
        quotas = quotas.select(F.col(label).alias("_label"), "n", "quota")
        every_fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        drawn = rows.join(quotas, rows[label].eqNullSafe(F.col("_label"))).withColumn("fold", every_fold)
        drawn = drawn.withColumn("_key", order_key(self.random_state, self.key_cols, F.col("fold").cast("string")))
        # A draw takes the first rows of a fold's order, so keys far beyond its share (ten standard
        # deviations and 50 rows) are left out before anything is shuffled.
        bound = (F.col("quota") + 10 * F.sqrt("quota") + 50) / F.col("n")
        drawn = drawn.where(uniform(F.col("_key")) < bound)
        ranked = ranks(drawn, ["fold", label], "_key", self.key_cols, digits=1).where("rank < quota")
        rare = classes.where("is_rare").select(F.col(label).alias("_label"))
        repeated = rows.join(rare, rows[label].eqNullSafe(F.col("_label")), "left_semi").withColumn("fold", every_fold)
        columns = ["fold", *rows.columns]
        return ranked.select(*columns).unionByName(repeated.select(*columns))

    def assign(self, data: DataFrame) -> DataFrame:
        return self.folds(data).select(names(F.col("fold"), "chunk").alias("partition"), *self.key_cols)


class TrainTestSplit(Strategy):
    """``train`` and ``test`` (a share of ``1 / n_partitions``), stratified while the label has few values."""

    def __init__(self, key_cols: list[str], label_col: str, n_partitions: int = 5, random_state: int = 42, most_classes: int = 100) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        self.label_col, self.most_classes = label_col, most_classes

    def assign(self, data: DataFrame) -> DataFrame:
        label = self.label_col
        rows = data.select(label, *[c for c in self.key_cols if c != label])
        stratify = rows.select(label).distinct().limit(self.most_classes).count() < self.most_classes
        rows = rows.withColumn("_class", F.col(label).cast("string") if stratify else F.lit(None).cast("string"))
        quotas = draw_quotas(rows.groupBy("_class").agg(F.count("*").alias("n")), "_class", self.n_partitions)
        rows = rows.withColumn("_key", order_key(self.random_state, self.key_cols))
        ranked = ranks(rows, ["_class"], "_key", self.key_cols)
        quotas = quotas.select(F.col("_class").alias("_c"), "quota")
        joined = ranked.join(quotas, F.col("_class").eqNullSafe(F.col("_c")))
        return joined.select(F.when(F.col("rank") < F.col("quota"), "test").otherwise("train").alias("partition"), *self.key_cols)


class MultilabelStratified(Strategy):
    """Disjoint folds in which every label keeps its share (iterative stratification, Sechidis et al. 2011).

    The scheme runs on the counts of label combinations, on the driver: combinations of the
    rarest label left go, row by row of count, to the folds that want that label most. A numeric
    column counts as raw labels, or as ``n_partitions`` quantile bins where more than
    ``uniqueness_threshold`` of its values are distinct.
    """

    #: Combinations of labels that the driver takes; more are refused, not cut.
    MOST_COMBINATIONS = 100_000

    def __init__(self, key_cols: list[str], label_cols: list[str], n_partitions: int = 5, random_state: int = 42, uniqueness_threshold: float = 0.3) -> None:
        super().__init__(key_cols, n_partitions, random_state)
        self.label_cols, self.uniqueness_threshold = list(label_cols), uniqueness_threshold

    def labelled(self, data: DataFrame) -> DataFrame:
        """Keys and ``combination``: the labels, binned where they are nearly unique, as one string."""
        from shardwright.operators.binning import bin_by_edges, quantile_edges

        rows = data
        total = None
        parts = []
        for c in self.label_cols:
            kind = dict(data.dtypes)[c]
            column = F.col(c)
            if kind in ("int", "bigint", "double", "float", "smallint") or kind.startswith("decimal"):
                total = total or data.count()
                if data.select(c).distinct().count() / max(total, 1) > self.uniqueness_threshold:
                    column = bin_by_edges(c, quantile_edges(data, c, self.n_partitions))
            parts.append(F.concat(F.lit(f"{c}="), F.coalesce(column.cast("string"), F.lit(""))))
        return rows.select(*self.key_cols, F.concat_ws("\x01", *parts).alias("combination"))

    def fold_counts(self, counts: dict[str, int]) -> dict[str, list[int]]:
        """How many rows of each combination each fold gets."""
        k = self.n_partitions
        labels = {combo: combo.split("\x01") for combo in counts}
        left = dict(counts)
        remaining: dict[str, int] = {}
        for combo, n in counts.items():
            for item in labels[combo]:
                remaining[item] = remaining.get(item, 0) + n
        wanted = {item: [n / k] * k for item, n in remaining.items()}
        room = [sum(counts.values()) / k] * k
        out = {combo: [0] * k for combo in counts}
        while any(left.values()):
            item = min((i for i, n in remaining.items() if n > 0), key=lambda i: (remaining[i], i))
            for combo in sorted(c for c, n in left.items() if n and item in labels[c]):
                while left[combo]:
                    fold = max(range(k), key=lambda f: (wanted[item][f], room[f], -f))
                    # As many at once as keep this fold the neediest by less than one row.
                    others = max((wanted[item][f] for f in range(k) if f != fold), default=0.0)
                    n = max(1, min(left[combo], int(wanted[item][fold] - others)))
                    out[combo][fold] += n
                    left[combo] -= n
                    room[fold] -= n
                    for other in labels[combo]:
                        wanted[other][fold] -= n
                        remaining[other] -= n
        return out

    def assign(self, data: DataFrame) -> DataFrame:
        spark = data.sparkSession
        rows = self.labelled(data).withColumn("_key", order_key(self.random_state, self.key_cols))
        counted = rows.groupBy("combination").count().limit(self.MOST_COMBINATIONS + 1).collect()
        if len(counted) > self.MOST_COMBINATIONS:
            raise ValueError(f"more than {self.MOST_COMBINATIONS} label combinations")
        shares = self.fold_counts({r["combination"]: r["count"] for r in sorted(counted)})
        spans = [
            (combo, fold, sum(by_fold[:fold]), sum(by_fold[: fold + 1]))
            for combo, by_fold in shares.items()
            for fold in range(self.n_partitions)
            if by_fold[fold]
        ]
        spans = spark.createDataFrame(spans, "combo string, fold int, first long, past long")
        ranked = ranks(rows, ["combination"], "_key", self.key_cols)
        joined = ranked.join(spans, (F.col("combination") == F.col("combo")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
        return joined.select(names(F.col("fold"), "chunk").alias("partition"), *self.key_cols)
