"""Class balancing within groups (folds): under-sampling, synthetic rows, and cleaning.

Rows have the groups, a key, a class and an array of doubles. Results have the same columns and
``synthetic``; synthetic rows have a null key. Which rows are drawn, which neighbour a synthetic
row leans to and how far are all seeded hashes. Rows without a label are a class of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.functions.ordering import order_key, ranks, uniform
from shardwright.operators.graph import checkpointed
from shardwright.operators.knn import at_places, nearest


def _class_join(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with the further columns of ``other``, which has a row per ``by``; null equals null."""
    renamed = other.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in other.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & rows[c].eqNullSafe(renamed[f"_by_{c}"])
    return rows.join(renamed, on).drop(*[f"_by_{c}" for c in by])


def _differ(a: str, b: str):
    return ~F.col(a).eqNullSafe(F.col(b))


class Balancer:
    """The columns and the seed that the resampling methods share."""

    #: Up to this place down the list all neighbours before it are listed too.
    FEW_PLACES = 20
    #: Up to so many keys that go after a cleaning are sent to all tasks, so that no point moves.
    FEW_LOST = 500_000

    def __init__(self, groups: list[str], key: str, label: str, features: str, seed: int = 42) -> None:
        self.groups, self.key, self.label, self.features, self.seed = groups, key, label, features, seed

    def class_counts(self, rows: DataFrame) -> DataFrame:
        """Groups, label, ``n``, and the least and largest class of the group."""
        counts = rows.groupBy(*self.groups, self.label).agg(F.count("*").alias("n"))
        group = Window.partitionBy(*self.groups) if self.groups else Window.partitionBy(F.lit(1))
        first = Window.partitionBy(*(self.groups or [F.lit(1)])).orderBy("n", self.label)
        return counts.select(
            *self.groups, self.label, "n", F.min("n").over(group).alias("least"), F.max("n").over(group).alias("most"), (F.row_number().over(first) == 1).alias("is_minority")
        )

    def _with_counts(self, rows: DataFrame) -> DataFrame:
        return _class_join(rows, self.class_counts(rows), [*self.groups, self.label])

    def _columns(self, synthetic: bool = False) -> list:
        return [*self.groups, self.key, self.label, self.features, F.lit(synthetic).alias("synthetic")]

    def random_under_sample(self, rows: DataFrame) -> DataFrame:
        """Every class cut to the smallest class of its group, in seeded order."""
        keyed = rows.withColumn("_key", order_key(self.seed, [self.key]))
        ranked = ranks(keyed, [*self.groups, self.label], "_key", [self.key])
        return self._with_counts(ranked).where("rank < least").select(*self._columns())

    def _synthesize(self, rows: DataFrame, wanted: DataFrame, k: int | None) -> DataFrame:
        """Rows between a base row and one of its neighbours of the same class.

        ``wanted`` has groups, label, key and ``_copy`` (from 0): one synthetic row each, known by
        ``_origin``. Without ``k`` any other row of the class may be the neighbour, however far
        down the list.
        """
        by = [*self.groups, self.label]
        counts = self.class_counts(rows).select(*by, "n", "least")
        limit = F.greatest(F.col("least") - 1, F.lit(1)) if k is None else F.lit(k)
        picks = _class_join(wanted, counts, by).withColumn("_k", F.least(limit, F.col("n") - 1)).where("_k > 0")
        h = order_key(self.seed, [self.key], F.col("_copy").cast("string"))
        picks = picks.withColumn("_h", h)
        place = F.pmod(F.conv(F.substring("_h", 9, 8), 16, 10).cast("bigint"), F.col("_k")) + 1
        picks = picks.withColumn("place", place.cast("int")).withColumn("_u", uniform(F.col("_h")))
        picks = checkpointed(picks)
        most = picks.agg(F.max("place")).first()[0]
        if not most:
            return rows.limit(0).select(*self._columns(True), F.lit(None).cast("string").alias("_origin"))
        key_type = dict(rows.dtypes)[self.key]
        columns = [*self.groups, F.lit(None).cast(key_type).alias(self.key), self.label, F.col("point").alias(self.features), F.lit(True).alias("synthetic"), F.concat_ws(":", self.key, "_copy").alias("_origin")]
        if most > self.FEW_PLACES:
            return at_places(rows, by, self.key, self.features, picks.select(*by, self.key, "place", "_copy", "_u"), "_u").select(*columns)
        near = nearest(rows, by, self.key, self.features, most, queries=rows.join(picks.select(*self.groups, self.key).distinct(), [*self.groups, self.key], "left_semi"))
        x = rows.select(*self.groups, self.key, F.col(self.features).alias("_x"))
        y = rows.select(*self.groups, F.col(self.key).alias("neighbour"), F.col(self.features).alias("_y"))
        near = near.select(*self.groups, self.key, "place", "neighbour")
        made = picks.join(near, [*self.groups, self.key, "place"]).join(x, [*self.groups, self.key]).join(y, [*self.groups, "neighbour"])
        point = F.transform("_x", lambda v, i: v + F.col("_u") * (F.get("_y", i) - v))
        return made.withColumn("point", point).select(*columns)

    def smote(self, rows: DataFrame, k: int | None = None) -> DataFrame:
        """Every class filled up to the largest of its group (Chawla et al. 2002).

        Base rows are taken in seeded order, over and over. ``k`` neighbours are open to choice,
        by default one less than the smallest class has rows.
        """
        return rows.select(*self._columns()).unionByName(self._smote(rows, k).drop("_origin"))

    def _smote(self, rows: DataFrame, k: int | None) -> DataFrame:
        """The synthetic rows only, with ``_origin``."""
        keyed = rows.withColumn("_key", order_key(self.seed, [self.key]))
        ranked = self._with_counts(ranks(keyed, [*self.groups, self.label], "_key", [self.key]))
        need = F.col("most") - F.col("n")
        copies = F.floor(need / F.col("n")) + F.when(F.col("rank") < need % F.col("n"), 1).otherwise(0)
        wanted = ranked.withColumn("_copies", copies).where("_copies > 0")
        wanted = wanted.select(*self.groups, self.label, self.key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
        return self._synthesize(rows, wanted, k)

    def adasyn(self, rows: DataFrame, k: int = 5) -> DataFrame:
        """Synthetic rows where a class lies among others (He et al. 2008).

        A row's weight is the share of other classes among its ``k`` neighbours in the group; a
        class gets weight times what it lacks, rounded row by row.
        """
        near = nearest(rows, self.groups, self.key, self.features, k)
        theirs = rows.select(*self.groups, F.col(self.key).alias("neighbour"), F.col(self.label).alias("_other"))
        own = self._with_counts(rows).where("n < most").select(*self.groups, self.key, self.label, "n", "most")
        hard = near.join(theirs, [*self.groups, "neighbour"]).join(own, [*self.groups, self.key])
        hard = hard.groupBy(*self.groups, self.label, self.key, "n", "most").agg(F.avg(F.when(_differ("_other", self.label), 1.0).otherwise(0.0)).alias("_r"))
        total = F.sum("_r").over(Window.partitionBy(*self.groups, self.label))
        copies = F.when(total > 0, F.floor(F.col("_r") / total * (F.col("most") - F.col("n")) + 0.5)).otherwise(0).cast("long")
        wanted = hard.withColumn("_copies", copies).where("_copies > 0")
        wanted = wanted.select(*self.groups, self.label, self.key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
        return rows.select(*self._columns()).unionByName(self._synthesize(rows, wanted, k).drop("_origin"))

    def _cleanable(self, rows: DataFrame, odd: DataFrame) -> DataFrame:
        """The groups and keys of ``odd`` that are not of the smallest class."""
        marked = self._with_counts(rows).where(~F.col("is_minority"))
        return marked.join(odd, [*self.groups, self.key], "left_semi").select(*self.groups, self.key)

    def _without(self, rows: DataFrame, lost: DataFrame) -> DataFrame:
        return rows.join(lost, [*self.groups, self.key], "left_anti")

    def edited_neighbours(self, rows: DataFrame, k: int = 3, everything: bool = False) -> DataFrame:
        """Drops rows of all classes but the smallest (or of all) that do not agree with all ``k`` neighbours (Wilson 1972)."""
        odd = self._disagreeing(rows, k)
        return self._without(rows, odd if everything else self._cleanable(rows, odd)).select(*self._columns())

    def _disagreeing(self, rows: DataFrame, k: int = 3) -> DataFrame:
        near = nearest(rows, self.groups, self.key, self.features, k)
        theirs = rows.select(*self.groups, F.col(self.key).alias("neighbour"), F.col(self.label).alias("_other"))
        mine = rows.select(*self.groups, self.key, F.col(self.label).alias("_mine"))
        odd = near.join(theirs, [*self.groups, "neighbour"]).join(mine, [*self.groups, self.key]).where(_differ("_other", "_mine"))
        return odd.select(*self.groups, self.key).distinct()

    def tomek_links(self, rows: DataFrame, everything: bool = False) -> DataFrame:
        """Drops rows of all classes but the smallest (or of all) that form a mutual nearest pair with another class (Tomek 1976)."""
        odd = self._linked(rows)
        return self._without(rows, odd if everything else self._cleanable(rows, odd)).select(*self._columns())

    def _linked(self, rows: DataFrame) -> DataFrame:
        near = checkpointed(nearest(rows, self.groups, self.key, self.features, 1).select(*self.groups, self.key, "neighbour"))
        back = near.select(*self.groups, F.col(self.key).alias("neighbour"), F.col("neighbour").alias(self.key))
        mutual = near.join(back, [*self.groups, self.key, "neighbour"])
        mine = rows.select(*self.groups, self.key, F.col(self.label).alias("_mine"))
        theirs = rows.select(*self.groups, F.col(self.key).alias("neighbour"), F.col(self.label).alias("_other"))
        pairs = mutual.join(mine, [*self.groups, self.key]).join(theirs, [*self.groups, "neighbour"]).where(_differ("_mine", "_other"))
        return pairs.select(*self.groups, self.key)

    def _then(self, rows: DataFrame, k: int | None, odd) -> DataFrame:
        """Cleans filled rows, some of which have no key: base key and copy stand in for it, so equal points stay apart.

        Points are stored, and moved to where they are compared, but not joined.
        """
        made = checkpointed(self._smote(rows, k))
        base = rows.select(*self._columns(), F.concat(F.lit("k:"), F.col(self.key).cast("string")).alias("_row"))
        named = base.unionByName(made.withColumn("_row", F.concat(F.lit("s:"), F.col("_origin"))).drop("_origin"))
        inner = Balancer(self.groups, "_row", self.label, self.features, self.seed)
        lost = checkpointed(odd(inner, named.select(*self.groups, "_row", self.label, self.features)))
        few = lost.count() <= self.FEW_LOST
        return inner._without(named, F.broadcast(lost) if few else lost).select(*self._columns()[:-1], "synthetic")

    def smote_enn(self, rows: DataFrame, k: int | None = None) -> DataFrame:
        return self._then(rows, k, Balancer._disagreeing)

    def smote_tomek(self, rows: DataFrame, k: int | None = None) -> DataFrame:
        return self._then(rows, k, Balancer._linked)


#: Method names and what they run; None balances nothing.
METHODS = {
    "rus": Balancer.random_under_sample,
    "smote": Balancer.smote,
    "adasyn": Balancer.adasyn,
    "enn": Balancer.edited_neighbours,
    "tomek": Balancer.tomek_links,
    "smoteenn": Balancer.smote_enn,
    "smotetomek": Balancer.smote_tomek,
}
