"""SpotSigs fingerprints (Theobald, Siddharth and Paepcke, 2008).

A signature is a common word (the anchor) and the chain of ``chain`` content words that follow
it, ``distance`` content words apart; a fingerprint is the set of a text's signatures. Sets are
partitioned by size and compared through pruned Jaccard: sizes too far apart cannot reach a
threshold, so those pairs are never looked at, and of the rest only those that share one of the
rarest signatures are verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import lean, materialize, prepare_workers, table, text_of
from shardwright.llm.textkit import mix, runs, words

#: The most common words of English, German, French, Spanish, Italian, Portuguese and Dutch.
ANCHORS = (
    "a an and are as at be been but by can could did do does for from had has have he her his if in into is it its "
    "not of on or our said she so than that the their them there they this to was we were what when which who will "
    "with would you "
    "aber als am auch auf aus bei bin das dass dem den der des die ein eine einem einen einer es für hat ich im ist "
    "mit nach nicht noch nur oder sich sie sind über um und von war wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils la le les leur mais ne nous ont ou par pas pour "
    "qu que qui sa se ses son sont sur un une vous "
    "al como con cual del el ella entre era eso esta este ha hay las lo los más muy no para pero por porque sin "
    "sobre su sus también todo y ya "
    "che da di gli ho i le nel nella non per più sono uma um os dos das não em na nas e o ao à het een van dat "
    "niet zijn op te voor met"
).split()


@lru_cache(1)
def _anchor_hashes() -> np.ndarray:
    return np.unique(words(list(dict.fromkeys(ANCHORS)))[0])


def _chains(hashes: np.ndarray, offsets: np.ndarray, chain: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and their offsets by text."""
    anchors = _anchor_hashes()
    at = np.minimum(np.searchsorted(anchors, hashes), len(anchors) - 1)
    is_anchor = anchors[at] == hashes
    content = hashes[~is_anchor]
    before = np.zeros(len(hashes) + 1, np.int64)  # content words before each word
    np.cumsum(~is_anchor, out=before[1:])
    spots = np.flatnonzero(is_anchor)
    text = np.searchsorted(offsets, spots, side="right") - 1
    first = before[spots]
    whole = first + (chain - 1) * distance < before[offsets[text + 1]]
    spots, text, first = spots[whole], text[whole], first[whole]
    mixed = hashes[spots]
    for i in range(chain):
        mixed = mix(mixed + content[first + i * distance])
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(text, minlength=len(offsets) - 1), out=out[1:])
    return mixed, out


def fingerprints(texts: list[str], chain: int = 2, distance: int = 1) -> list[np.ndarray]:
    """The sorted 32-bit signature set of each text.

    A text without a whole anchored chain takes every run of ``chain`` + 1 words instead (its
    words together if there are fewer); one without words but not empty, its own hash; the
    empty text has the empty set.
    """
    hashes, offsets = words(texts)
    values, at = _chains(hashes, offsets, chain, distance)
    bare = np.diff(at) == 0
    if bare.any():
        others, their = runs(hashes, offsets, chain + 1)
    found = []
    for i, text in enumerate(texts):
        own = others[their[i] : their[i + 1]] if bare[i] else values[at[i] : at[i + 1]]
        if not len(own) and text:
            own = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], ">u8")
        found.append(np.unique((own >> np.uint64(32)).astype(np.uint32)))
    return found


def as_string(signatures: np.ndarray) -> str:
    """The set's size, which is its partition, and its signatures in ascending order, 8 hex digits each."""
    return f"{len(signatures)}:{signatures.astype('>u4').tobytes().hex()}"


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without a comparison if their sizes rule out ``at_least``. Two empty sets: 1."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small / large < at_least:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def in_order(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """Rows dealt out so that each meets its successor: ``doc_id, text, cell, own``.

    Documents are cut by id into ranges; each range also gets, with ``own`` false and sorted
    last, the rows with the largest id of the range below it (the lowest range gets those of
    the highest). Within a partition rows are sorted by range, then descending by id, then by
    text. The cuts are quantiles of the ids, so at most ``cells`` numbers come to the driver;
    texts move in one shuffle.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells or max(2, 4 * parts)
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", text_of().alias("text"))
    shares = [i / cells for i in range(1, cells)]
    cuts = rows.agg(F.percentile_approx("key", shares, 100 * cells)).first()[0]
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[::step]])
    fine = F.array(*[F.array(*[F.lit(c).cast("long") for c in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
    passed = F.size(F.filter(coarse, lambda c: c < F.col("key")))
    inner = F.size(F.filter(F.element_at(fine, passed), lambda c: c < F.col("key")))
    cell = F.when(passed > 0, (passed - 1) * step + inner).otherwise(0) if cuts else F.lit(0)
    rows = rows.withColumn("cell", cell)
    tops = rows.groupBy("cell").agg(F.max("key").alias("top")).orderBy("cell").collect()
    helps = [(t["top"], tops[(i + 1) % len(tops)]["cell"]) for i, t in enumerate(tops)]
    helps = spark.createDataFrame(helps, "top long, goes_to int")
    rows = rows.join(F.broadcast(helps), F.col("key") == F.col("top"), "left")
    own = F.struct(F.col("cell"), F.lit(True).alias("own"))
    help_ = F.struct(F.col("goes_to").alias("cell"), F.lit(False).alias("own"))
    to = F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, help_))
    rows = rows.select("doc_id", "key", "text", F.explode(to).alias("to"))
    rows = rows.select("doc_id", "key", "text", "to.cell", "to.own").repartition(parts, "cell")
    return rows.sortWithinPartitions("cell", F.desc("own"), F.desc("key"), "text").drop("key")


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def edited_table(docs: DataFrame, chain: int = 2, distance: int = 1) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    The next document is the one with the next smaller doc_id (rows that repeat a doc_id follow
    by text); after the last comes the first, and a lone document follows itself. Null text is
    empty; a null doc_id is the smallest. An empty table gives an empty result; other columns
    are ignored.
    """
    prepare_workers(docs.sparkSession)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row: its successor is still to come
        for batch in batches:
            ids, texts, cells, own = (batch.column(i).to_pylist() for i in range(4))
            prints = fingerprints(texts, chain, distance)
            if held is not None:
                ids, texts, cells, own, prints = ([h, *rest] for h, rest in zip(held, (ids, texts, cells, own, prints), strict=True))
            held = ids[-1], texts[-1], cells[-1], own[-1], prints[-1]
            pairs = [i for i in range(len(ids) - 1) if own[i] and cells[i] == cells[i + 1]]
            changed = [edited(texts[i], texts[i + 1]) for i in pairs]
            theirs = fingerprints(changed, chain, distance)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[i] for i in pairs], pa.int64()),
                    "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    "fingerprint": pa.array([as_string(prints[i]) for i in pairs], pa.string()),
                    "edited_fingerprint": pa.array([as_string(p) for p in theirs], pa.string()),
                    "near_edited": pa.array([jaccard(prints[i], p) for i, p in zip(pairs, theirs, strict=True)], pa.float64()),
                    "near_next": pa.array([jaccard(prints[i], prints[i + 1]) for i in pairs], pa.float64()),
                }
            )

    return in_order(docs).mapInArrow(lean(work), schema)


def representatives(signatures: DataFrame) -> DataFrame:
    """``id, signatures, representative``: the least id of the sets equal to each set of ``signatures`` (``id, signatures``).

    Sets are named by a digest of their sorted members, so copies meet as small rows and only
    in a partial aggregate. A null set is empty; a null id is never the least unless all are.
    """
    members = F.array_sort(F.coalesce("signatures", F.array().cast(dict(signatures.dtypes)["signatures"])))
    rows = signatures.select("id", members.alias("signatures")).withColumn("_set", F.sha2(F.to_json(F.struct("signatures")), 256))
    least = rows.groupBy("_set").agg(F.min("id").alias("representative"))
    return rows.join(least, "_set").select("id", "signatures", "representative")


def near_pairs(signatures: DataFrame, at_least: float = 0.8, slice_rows: int = 1000) -> DataFrame:
    """Pairs of different sets alike to at least ``at_least``: ``id_a, id_b, likeness`` with id_a < id_b.

    ``signatures`` has ``id`` and ``signatures`` (an array of distinct hashes). Of equal sets
    only the least id stands in pairs; ``representatives`` says for whom. Sets are put into size
    partitions whose bounds grow by 1 / ``at_least``, so partners lie in the same or the next
    one. Only the rarest signatures of a set, as many as no partner can do without, are looked
    up; sizes are compared before the sets are. A signature of many sets is split into slices of
    about ``slice_rows`` on one side, which the other side meets in turn. Empty and null sets
    and null ids have no partner; an empty table gives an empty result.
    """
    rows = signatures.where("id IS NOT NULL AND size(signatures) > 0")
    rows = rows.withColumn("_set", F.sha2(F.to_json(F.struct(F.array_sort("signatures").alias("s"))), 256))
    rows = rows.groupBy("_set").agg(F.min("id").alias("id"), F.first("signatures").alias("signatures")).drop("_set")
    rows = materialize(rows.withColumn("n", F.size("signatures")))
    listed = rows.select("id", "n", F.explode("signatures").alias("s"))
    counts = listed.groupBy("s").agg(F.count("*").alias("c"))
    ranked = listed.join(counts, "s").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("c", "s")))
    probes = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1) & (F.col("c") > 1))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / at_least)))
    slices = F.ceil(F.col("c") / slice_rows).cast("int")
    probes = materialize(probes.select("id", "n", "s", part.alias("part"), slices.alias("slices")))
    left = probes.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), "s", "slices", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    left = left.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    right = probes.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "s", "part", F.pmod(F.hash("id"), F.col("slices")).alias("slice"))
    near = left.join(right, ["s", "part", "slice"]).where(
        (F.col("id_a") != F.col("id_b"))
        & (F.col("n_a") <= F.col("n_b"))
        & (F.col("n_a") >= F.col("n_b") * at_least - 1e-9)
    )
    pairs = near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    a = rows.select(F.col("id").alias("id_a"), F.col("signatures").alias("sig_a"))
    b = rows.select(F.col("id").alias("id_b"), F.col("signatures").alias("sig_b"))
    shared = F.size(F.array_intersect("sig_a", "sig_b"))
    likeness = shared / (F.size("sig_a") + F.size("sig_b") - shared)
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", likeness.alias("likeness")).where(F.col("likeness") >= at_least - 1e-12)


def op3_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edited_table(table(spark, sf_dir, "documents"))
