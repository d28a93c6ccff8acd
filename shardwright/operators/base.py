"""The contract of all strategies."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


def names(values, prefix: str):
    """Partition names such as ``chunk_3``."""
    from pyspark.sql import functions as F

    return F.concat(F.lit(f"{prefix}_"), values.cast("string"))


class Strategy(ABC):
    """Maps rows to named partitions; a row may be in none, one or many.

    ``assign`` gives ``partition`` and the key columns, ``materialize`` the rows themselves with
    their partition. Plans are lazy; where a strategy needs figures first (quotas, edges) it
    gathers small aggregates.
    """

    def __init__(self, key_cols: list[str], n_partitions: int = 5, random_state: int = 42) -> None:
        if n_partitions < 1:
            raise ValueError("n_partitions must be at least 1")
        if not key_cols:
            raise ValueError("key_cols must name the columns that identify a row")
        self.key_cols, self.n_partitions, self.random_state = list(key_cols), n_partitions, random_state

    @abstractmethod
    def assign(self, data: DataFrame) -> DataFrame: ...

    def materialize(self, data: DataFrame) -> DataFrame:
        """Rows of ``data`` with their partition: a join on the keys, null-safe.

        A table that already has a column of that name is refused, as one of the two would be lost.
        """
        placed = self.assign(data)
        taken = [c for c in placed.columns if c not in self.key_cols and c.lower() in map(str.lower, data.columns) and c != getattr(self, "series_col", None)]
        if taken:
            raise ValueError(f"the table already has a column {taken[0]!r}; rename it first")
        renamed = placed.select(*[placed[c].alias(f"_key_{c}" if c in self.key_cols else c) for c in placed.columns])
        on = None
        for c in self.key_cols:
            same = data[c].eqNullSafe(renamed[f"_key_{c}"])
            on = same if on is None else on & same
        extra = [c for c in renamed.columns if not c.startswith("_key_") and c not in data.columns]
        return data.join(renamed, on).select(*extra, *[data[c] for c in data.columns])

    fit_transform = materialize

    def check_partitions(self, data: DataFrame) -> DataFrame | None:
        """A hook for reports; none by default."""
        return None
