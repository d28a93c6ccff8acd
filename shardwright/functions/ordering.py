"""Seeded hash order and exact ranks that no single task has to compute.

Every random choice is an order of rows by ``md5(seed:key)``: reproducible, independent of
partitioning, and the same in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: str | int, keys: list[str], *more: Column) -> Column:
    """32 hex digits that order rows at random; ``more`` goes between the seed and the keys."""
    parts = [F.lit(str(seed)), *more, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of an order key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & a[c].eqNullSafe(b[f"_{c}"])
    return found


def sliced_ranks(rows: DataFrame, groups: list[str], slice_: str, order: list) -> DataFrame:
    """Adds ``rank`` (from 0, by ``order``) and ``total`` within ``groups``; drops ``slice_``.

    ``slice_`` numbers or names consecutive pieces of the order. Rows are ranked within a piece
    and shifted by the counts of the pieces before, so a group of any size spreads over many
    tasks. The counts are one row per group and piece.
    """
    by = [*groups, slice_]
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = group.orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        F.sum("_n").over(group).alias("total"),
    )
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    joined = ranked.join(shifts, _same(ranked, shifts, by))
    return joined.select(*[ranked[c] for c in rows.columns if c != slice_], (F.col("_shift") + F.col("_rn") - 1).alias("rank"), "total")


def ranks(rows: DataFrame, groups: list[str], key: str, ties: list[str], digits: int = 2) -> DataFrame:
    """Adds ``rank`` (from 0, by hash ``key`` then ``ties``) and ``total`` within ``groups``.

    The first ``digits`` hex digits of the key cut each group into 16**digits pieces.
    """
    return sliced_ranks(rows.withColumn("_slice", F.substring(key, 1, digits)), groups, "_slice", [key, *ties])


def _passed(column: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < column))


def value_ranks(rows: DataFrame, value: str, ties: list[str], cells: int = 256) -> DataFrame:
    """Adds ``rank`` (from 0, ascending by a numeric column, null first, then by ``ties``) and ``total`` over all rows.

    Cut at approximate quantiles (at most ``cells`` numbers come to the driver); ranks are exact.
    A value that fills a cell by itself, and null, is cut again by the first of ``ties`` if that
    is a number; there are at most ``cells`` such values, with as many cuts together.
    """
    shares = [i / cells for i in range(1, cells)]
    found = rows.agg(F.percentile_approx(value, shares)).first()[0] or []
    cuts = sorted(set(found))
    cell = _passed(F.col(value), F.array(*[F.lit(c) for c in cuts])) if cuts else F.lit(0)
    rows = rows.withColumn("_cell", F.when(F.col(value).isNull(), -1).otherwise(cell))
    often = {c: found.count(c) for c in cuts if found.count(c) > 1}
    column, piece = F.col(value), F.lit(0)
    kinds = dict(rows.dtypes)
    if ties and kinds[ties[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        hot = column.isNull() | column.isin(*often) if often else column.isNull()
        split = rows.where(hot).groupBy(value).agg(F.percentile_approx(ties[0], shares).alias("cuts")).collect()
        for r in split:
            n = often.get(r[value], cells)
            inner = sorted(set((r["cuts"] or [])[:: max(1, cells // n)]))
            if inner:
                piece = F.when(column.eqNullSafe(F.lit(r[value])), _passed(F.col(ties[0]), F.array(*[F.lit(c) for c in inner])) + 1).otherwise(piece)
    rows = rows.withColumn("_cell", F.struct(F.col("_cell").alias("c"), piece.alias("p")))
    return sliced_ranks(rows, [], "_cell", [column.asc_nulls_first(), *ties])


def exact_quantiles(data: DataFrame, value: str, shares: list[float], rows_a_cell: int = 1_000_000) -> list[float]:
    """Exact quantiles of a numeric column without nulls, with linear interpolation; empty for no value.

    Up to ``rows_a_cell`` rows go through the built-in aggregate. More are cut into cells at
    approximate quantiles; the cells that hold a wanted place are counted out by value, so no
    task sees more than a cell's distinct values.
    """
    column = F.col(value).cast("double")
    rows = data.select(column.alias("v")).where("v IS NOT NULL")
    n = rows.count()
    if n <= rows_a_cell:
        return rows.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0] or []
    cells = min(10_000, -(-n // rows_a_cell))
    cuts = sorted(set(rows.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 10 * cells)).first()[0]))
    rows = rows.withColumn("cell", _passed(F.col("v"), F.array(*[F.lit(c) for c in cuts])))
    sizes = dict(rows.groupBy("cell").count().collect())
    starts, at = {}, 0
    for cell in sorted(sizes):
        starts[cell], at = at, at + sizes[cell]
    places = sorted({p for s in shares for p in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))})
    wanted = {p: max(c for c in starts if starts[c] <= p) for p in places}
    counts = rows.where(F.col("cell").isin(*set(wanted.values()))).groupBy("cell", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("v"))
    runs = counts.select("cell", "v", (upto - F.col("n")).alias("first"), upto.alias("past"))
    inside = [(F.col("cell") == c) & (F.col("first") <= p - starts[c]) & (F.col("past") > p - starts[c]) for p, c in wanted.items()]
    hits = runs.select("v", F.array_compact(F.array(*[F.when(x, p) for x, p in zip(inside, wanted, strict=True)])).alias("places")).where(F.size("places") > 0)
    known = {p: r["v"] for r in hits.collect() for p in r["places"]}
    found = []
    for s in shares:
        low = int(s * (n - 1))
        part = s * (n - 1) - low
        found.append(known[low] if not part else (1 - part) * known[low] + part * known[low + 1])
    return found


def ntile_of(rank: Column, total: Column, k: int) -> Column:
    """Which of ``k`` near-equal runs a rank falls in, from 0; the first ``total % k`` runs have one more."""
    base, extra = F.floor(total / k), total % k
    wide = extra * (base + 1)
    low = F.floor(rank / (base + 1))
    high = extra + F.floor((rank - wide) / F.greatest(base, F.lit(1)))
    return F.when(rank < wide, low).otherwise(high).cast("int")
