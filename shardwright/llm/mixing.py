"""Mixing sources to target weights by capped water-filling.

Each source's share of the mix follows its weight, but never exceeds ``max_epochs`` times its
own size; what a capped source cannot take is reshared by weight over the others until none is
above its cap. A source is then taken in whole repetitions plus a seeded fractional one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import all_columns, fresh, materialize, prepare_workers, table, text_of

#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(totals: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` for ``totals`` with ``source, source_size``.

    Sources weigh ``weights`` in turn, in code point order with null last. Sorted by cap over
    weight, sources are capped from the front while the level that would serve the rest lies
    above their ratio; the rest get weight times level, which is where repeated resharing
    ends. One row per source passes here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumn("level", left / open_weight)
    # The first source whose ratio reaches its level sets the level of all that follow.
    levels = levels.withColumn("place", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level["level"] * F.col("weight")))
    return levels.select("source", "source_size", target.alias("target"))


def _choose(rows: pd.DataFrame) -> pd.Series:
    """Which units get the extra repetition: each if the words wanted so far and not yet taken reach its own drawn share of its size.

    ``draw`` is uniform, so the first unit is taken with the probability ``fraction``, and what a
    draw leaves open the smaller units after it make up for.
    """
    gap = 0.0
    chosen = []
    for size, fraction, draw in zip(rows["unit"], rows["fraction"], rows["draw"], strict=True):
        gap += fraction * size
        take = 0 < fraction and gap > draw * size
        gap -= size if take else 0
        chosen.append(take)
    return pd.Series(chosen, index=rows.index, dtype=bool)


def repetitions(
    sized: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    cell_rows: int = 1024,
) -> DataFrame:
    """How often each document of ``sized`` (``doc_id, source, size``) enters the mix.

    Gives ``doc_id, source, size, copies, source_size, target, repeats`` with one row for each
    distinct (doc_id, source, size); the ``copies`` rows that share it are one unit. The whole
    repetitions are ``floor(target / source_size)``. For the fraction, units of a source are
    dealt by seeded hash over cells of about ``cell_rows`` rows, so no task holds a whole
    source; within a cell they pass from large to small (powers of two, then seeded order) and
    each is taken by its own seeded draw against the words that the cell still lacks, which
    leaves an error of about one small document a cell.
    """
    prepare_workers(sized.sparkSession)
    units = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    totals = materialize(totals)
    filled = water_fill(totals.select("source", "source_size"), weights, share, max_epochs)
    filled = materialize(filled.join(totals.select(F.col("source").alias("s"), "source_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.floor(rate).cast("long").alias("whole"),
        (rate - F.floor(rate)).alias("fraction"),
        F.ceil(F.col("source_rows") / cell_rows).alias("cells"),
    )
    filled = F.broadcast(filled) if filled.count() <= BROADCAST_SOURCES else filled
    rows = units.join(filled, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("size")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.withColumn("order", order).withColumn("draw", draw).withColumn("unit", F.col("size") * F.col("copies"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("cells")))
    schema = "doc_id long, source string, size long, copies long, source_size long, target double, repeats long"

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(kind=part["unit"].map(lambda n: int(n).bit_length()))
        part = part.sort_values(["kind", "order", "doc_id"], ascending=[False, True, True], kind="stable")
        part["repeats"] = part["whole"] + _choose(part).astype("int64")
        return part[["doc_id", "source", "size", "copies", "source_size", "target", "repeats"]].astype({"doc_id": "Int64"})

    return rows.groupBy("source", "cell").applyInPandas(cell, schema)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``; a null text has size 0."""
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"))


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``target`` is that of the document's source; ``taken`` counts the words the mix takes,
    repeats included. A null text has size 0 and takes nothing; null sources are one source.
    Rows that repeat (doc_id, source, size) share their fate. If no text has a word all targets
    are 0. An empty table gives an empty result; other columns are ignored.
    """
    units = repetitions(materialize(sizes(docs)), **options)
    return units.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "copies"
    ).select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_n")).drop("_n")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as its repetitions say, all columns kept.

    Nulls, repeated rows and empty tables as in ``mix_table``; other columns may have any name.
    Documents that share doc_id and source but not their size are told apart by it.
    """
    sized = materialize(sizes(docs))
    units = materialize(repetitions(sized, **options))
    own = fresh(docs, "_id", "_source", "_size", "_repeats", "_words", "_copy")
    key, source, size, repeats, words, copy = own
    units = units.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("repeats").alias(repeats))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source))
    keyed = docs
    # Words are counted again only where a doc_id and source have several sizes.
    if not units.groupBy(key, source).count().where("count > 1").isEmpty():
        keyed = docs.withColumn(words, word_count(text_of()))
        same &= F.col(words) == F.col(size)
    joined = keyed.join(units.where(F.col(repeats) > 0), same)
    joined = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(repeats))))
    return joined.select(*all_columns(docs))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))
