"""Exact duplicate removal with a heavy-hitter split.

A Misra-Gries style frequent-items sketch names the few digests that may be very
frequent; an exact, map-side combined count verifies them. The verified winners (at most
``1 / heavy_share`` of them, by arithmetic) are broadcast, so rows of the hottest groups
never meet in one task. All other digests take the ordinary shuffle, in which no group
holds more than ``heavy_share`` of the rows. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import all_columns, fresh, materialize, table, text_of


#: Pairs of digest and id up to this number are broadcast; about 100 bytes each.
FEW_LOST = 500_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, rid``, stored once: later passes read a few bytes a row, not the texts."""
    return materialize(
        docs.select(F.col(id_col).alias("id"), F.sha2(text_of(text_col).cast("binary"), 256).alias("digest")).withColumn(
            "rid", F.monotonically_increasing_id()
        )
    )


def frequent_digests(rows: DataFrame, total: int, heavy_share: float) -> DataFrame:
    """Digests that hold at least ``heavy_share`` of the rows, with exact size and winner.

    The sketch tracks eight times ``1 / heavy_share`` items, so that its error is below the
    share sought and no such digest is missed; its estimates are then replaced by counts.
    """
    most = max(1, int(1 / heavy_share))
    tracked = 1 << (8 * most - 1).bit_length()
    named = rows.agg(F.expr(f"approx_top_k(digest, {most}, {tracked})").alias("top")).select(
        F.explode("top").alias("t")
    )
    named = named.select(F.col("t.item").alias("digest"))
    counted = (
        rows.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("id", "rid")).alias("winner"))
    )
    return materialize(counted.where(F.col("group_size") >= F.lit(heavy_share * total)))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = 0.001
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row
    with the largest id stays. A null id sorts below all others. Of rows that repeat both id
    and text exactly one stays. An empty table gives an empty result; other columns are
    ignored.
    """
    rows = digests(docs, id_col, text_col)
    heavy = F.broadcast(frequent_digests(rows, rows.count(), heavy_share))
    hot = rows.join(heavy, "digest")
    group = Window.partitionBy("digest")
    cold = rows.join(heavy, "digest", "left_anti").select(
        "digest",
        "id",
        "rid",
        F.count("*").over(group).alias("group_size"),
        F.max(F.struct("id", "rid")).over(group).alias("winner"),
    )
    return hot.unionByName(cold).select(
        F.col("id").alias("doc_id"),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("winner.rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, heavy_share: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns and whole texts.

    What goes is settled on digests alone, heavy groups by their broadcast winners. Up to
    ``FEW_LOST`` pairs of digest and id that go are broadcast, and then no text moves; more are
    joined by shuffle, after the copies of heavy groups have gone where they lie. Rows that
    repeat id and text are reduced to one of them. A null text equals the empty one, a null id
    sorts below all others, an empty table stays empty, and other columns may have any name.
    """
    rows = digests(docs)
    heavy = frequent_digests(rows, rows.count(), heavy_share)
    hot = rows.join(F.broadcast(heavy), "digest")
    cold = rows.join(F.broadcast(heavy), "digest", "left_anti")
    copied = cold.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "rid")).alias("winner")).where("group_size > 1")
    members = hot.unionByName(cold.join(copied, "digest"))
    stays = F.col("id").eqNullSafe(F.col("winner.id"))
    marked = materialize(members.groupBy("digest", "id", stays.alias("stays")).agg(F.count("*").alias("n")).where("NOT stays OR n > 1"))
    digest, lost_digest, lost_id = fresh(docs, "_digest", "_lost_digest", "_lost_id")
    named = [F.col("digest").alias(lost_digest), F.col("id").alias(lost_id)]
    few = marked.count() <= FEW_LOST
    lost, repeated = (F.broadcast(x) if few else x for x in (marked.where("NOT stays").select(*named), marked.where("stays").select(*named)))
    same = (F.col(digest) == F.col(lost_digest)) & F.col("doc_id").eqNullSafe(F.col(lost_id))
    left = docs.withColumn(digest, F.sha2(text_of().cast("binary"), 256))
    if not few:
        winners = heavy.select(F.col("digest").alias(lost_digest), F.col("winner.id").alias(lost_id))
        beaten = (F.col(digest) == F.col(lost_digest)) & ~F.col("doc_id").eqNullSafe(F.col(lost_id))
        left = left.join(F.broadcast(winners), beaten, "left_anti")
    kept = left.join(lost, same, "left_anti")
    if not marked.where("stays").isEmpty():
        single = kept.join(repeated, same, "left_semi").dropDuplicates([digest])
        kept = kept.join(repeated, same, "left_anti").unionByName(single)
    return kept.select(*all_columns(docs))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, text_sha256,
             max(doc_id) OVER (PARTITION BY t) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn
      FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM g
"""
