"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

1. Equal texts form one node. Each node has ``TREES`` labels of MinHash values over its word
   five-grams; a prefix of a label is a node of that tree's trie, named by a hash of tree and
   prefix, so that a level of all tries is one grouping by name and needs no sort.
2. Texts are matched from the longest prefix at which one can reach the target recall, by
   ``recall``. Members of a trie node of up to ``crowd`` texts are compared by a sketch of one
   byte per MinHash value, and those that may reach the threshold are linked, a few links per
   node, never all its pairs. A text that lost so many of its trees to crowds that it falls
   short of the target has its prefixes shortened; a partner that has reached the target has
   seen every node that the two share, so only texts that are still open go on.
3. Texts that no prefix serves (those of large groups of near copies, and texts made of
   passages that many share) are matched with each other exactly: two texts at the threshold
   share one of the rarest shingles of each, as many as neither can do without, in any common
   order of all shingles; here frequent ones come last. Up to ``4 * crowd`` texts with such a
   shingle are compared by sketch, more are all linked.
4. Components of the links hold every candidate pair. Within a component all pairs are verified
   on their whole shingle sets, in blocks of bounded size. Links are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import all_columns, fresh, lean, materialize, packed, prepare_workers, table, text_of
from shardwright.llm.components import HOT_SHARE, connected_components
from shardwright.llm.textkit import BATCH_CHARS, mix, runs, words

SHINGLE = 5
TREES = 16
#: Values of a label, and how many prefix lengths are tried from the longest that serves.
LABEL, TRIED = 6, 3
VALUES = TREES * LABEL
#: Least share of the partners at the threshold that the forest has to find for a text.
TARGET = 0.999
#: Sketch likeness may fall below the threshold by so much (about five standard errors).
SLACK = 0.2
#: Texts compared with each other in one piece of work.
BLOCK = 1000
#: Components up to this size are compared pair by pair.
FEW = 12
#: Cells of the table of frequent shingles, which is broadcast.
CELLS = 1 << 21
#: Node names up to this number are broadcast, to move fewer texts; 16 bytes each.
FEW_NODES = 1_000_000


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20080)
    a = rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def recall(length: int, crowded: int, threshold: float) -> float:
    """The least probability that a pair at the threshold meets in a trie node at this prefix length that is no crowd.

    One tree brings the pair together with threshold ** length. ``crowded`` of a text's trees
    ended in crowds; in the worst case the pair would have met in each of them, so that share
    of the trees is taken off.
    """
    meets = max(0.0, threshold**length - crowded / TREES)
    return 1 - (1 - meets) ** TREES


def lengths(threshold: float, target: float) -> list[int]:
    """Prefix lengths to try, the longest first; empty if not even one value brings a text to the target."""
    served = [k for k in range(LABEL, 0, -1) if recall(k, 0, threshold) >= target]
    return served[:TRIED]


def min_hashes(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``VALUES`` 32-bit minima per text; every text must have a shingle."""
    out = np.empty((len(offsets) - 1, VALUES), np.uint32)
    for i, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
        out[:, i] = np.minimum.reduceat(((shingles * a + b) >> np.uint64(32)).astype(np.uint32), offsets[:-1])
    return out


def shingle_sets(texts: list[str], length: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of word n-gram hashes of each text."""
    values, at = runs(*words(texts), length)
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of the list with about ``BATCH_CHARS`` of text each."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= BATCH_CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _new(nodes: list[bytes], seen: set, most: int = 200_000) -> list[int]:
    """Places of the nodes not met before in this task; ``seen`` forgets all once it is full."""
    if len(seen) > most:
        seen.clear()
    places = []
    for i, node in enumerate(nodes):
        if node not in seen:
            seen.add(node)
            places.append(i)
    return places


def signatures(nodes: DataFrame, tried: list[int]) -> DataFrame:
    """Sketch and trie nodes of each node with a shingle: ``node, sketch`` and an array over trees ``at_k`` for each length k."""
    fields = "".join(f", at_{k} array<long>" for k in tried)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = batch.take(pa.array(_new(batch.column(0).to_pylist(), seen), pa.int32()))
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                values, at = runs(*words(texts[begin:end]), SHINGLE)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                minima = min_hashes(values, np.append(at[:-1][some], at[-1]))
                labels = minima.reshape(len(some), TREES, LABEL).astype(np.uint64)
                name = mix(np.arange(1, TREES + 1, dtype=np.uint64))[None, :]
                ends = np.arange(len(some) + 1, dtype=np.int32) * TREES
                columns = {
                    "node": batch.column(0).slice(begin, end - begin).take(pa.array(some)).cast(pa.binary()),
                    "sketch": pa.array([row.tobytes() for row in (minima & np.uint32(255)).astype(np.uint8)], pa.binary()),
                }
                names = {}
                for k in range(1, LABEL + 1):
                    name = mix(name ^ labels[:, :, k - 1])
                    names[k] = name
                columns |= {f"at_{k}": pa.ListArray.from_arrays(ends, pa.array(names[k].view(np.int64).ravel())) for k in tried}
                yield pa.RecordBatch.from_pydict(columns)

    found = nodes.select("node", "text").mapInArrow(lean(work), f"node binary, sketch binary{fields}")
    kept = [F.first(c).alias(c) for c in found.columns[1:]]
    return found.groupBy("node").agg(*kept)


def _linked(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least member of each member's component under the pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def bucket_links(buckets: DataFrame, at_least: float) -> DataFrame:
    """Links ``u, v`` that connect the members of each bucket (``members``: node and sketch) that are alike by sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            flat = lists.values
            nodes = flat.field("node").to_pylist()
            sketches = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
            us, vs = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = sketches[a:b]
                i, j = np.triu_indices(b - a, 1)
                near = np.count_nonzero(own[i] == own[j], axis=1) >= at_least * VALUES
                if near.any():
                    root = _linked(np.stack([i[near], j[near]], axis=1), b - a)
                    for x in np.flatnonzero(root != np.arange(b - a)):
                        us.append(nodes[a + x])
                        vs.append(nodes[a + root[x]])
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return buckets.select("members").mapInArrow(lean(work), "u binary, v binary")


def _joined(rows: DataFrame, small: DataFrame, by: str, total: int) -> DataFrame:
    """``rows`` joined with ``small``, which has a row per key with ``n``, the number of rows (``total`` in all) that bear it.

    Keys with more than ``HOT_SHARE`` of the rows, of which there are at most a thousand, are
    broadcast; the others are joined by shuffle. ``small`` is read three times.
    """
    most = max(2.0, HOT_SHARE * total)
    hot = small.where(F.col("n") >= most)
    near = rows.join(F.broadcast(hot), by)
    far = rows.join(F.broadcast(hot.select(by)), by, "left_anti").join(small.where(F.col("n") < most), by)
    return near.unionByName(far)


def _only(texts: DataFrame, nodes: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``texts`` with a node of ``nodes`` (or without); few nodes are broadcast, so that only these texts move later."""
    few = nodes.count() <= FEW_NODES
    return texts.join(F.broadcast(nodes) if few else nodes, "node", how)


def _bucket_links(rows: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Links within the buckets of ``rows`` (``bucket, node``), compared by sketch; a long text may be in very many buckets."""
    rows = materialize(rows)
    held = materialize(sketches.join(rows.groupBy("node").agg(F.count("*").alias("n")), "node"))
    members = _joined(rows, held, "node", rows.count()).groupBy("bucket").agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
    return bucket_links(members, threshold - SLACK)


def forest_links(sigs: DataFrame, tried: list[int], threshold: float, target: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Links ``u, v`` that the forest finds, and the nodes (``node``) that it leaves short of the target."""
    left, buckets = sigs.select("node"), None
    for k in tried:
        rows = (sigs if buckets is None else sigs.join(left, "node")).select("node", F.explode(f"at_{k}").alias("bucket"))
        rows = rows if buckets is None else materialize(rows)
        counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        met = _joined(rows, counts, "bucket", total)
        small = met.where(F.col("n") <= crowd).select("bucket", "node")
        buckets = small if buckets is None else buckets.unionByName(small)
        lost = met.where(F.col("n") > crowd).groupBy("node").agg(F.count("*").alias("crowded"))
        most = max((c for c in range(TREES + 1) if recall(k, c, threshold) >= target), default=-1)
        left = materialize(packed(lost.where(F.col("crowded") > most).select("node"), total))
        if left.isEmpty():
            break
    if buckets is None:
        return sigs.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0), left
    return _bucket_links(buckets, sigs.select("node", "sketch"), threshold), left


def _frequent(texts: DataFrame) -> np.ndarray:
    """How often shingles occur that some task met at least twice, by ``CELLS`` cells of their hashes; no more than a good order needs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"cell": pa.array(cells[times > 1], pa.int32()), "n": pa.array(times[times > 1], pa.int64())})

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _slices(texts):
                values, _ = runs(*words(texts[begin:end]), SHINGLE)
                held.append((values % np.uint64(CELLS)).astype(np.int32))
                n += len(values)
                if n > 1 << 22:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    sums = texts.select("text").mapInArrow(lean(work), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return np.minimum(often, np.iinfo(np.uint32).max).astype(np.uint32)


def rarest(shingles: np.ndarray, often: np.ndarray, threshold: float) -> np.ndarray:
    """Of a set, its first members in the order of all shingles, as many as a partner at the threshold must share one of."""
    n = len(shingles)
    most = n - int(np.ceil(threshold * n - 1e-9)) + 1
    order = np.lexsort((shingles, often[(shingles % np.uint64(CELLS)).astype(np.int64)]))
    return shingles[order[: max(1, min(n, most))]]


def rare_links(texts: DataFrame, sketches: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """Links whose components hold every pair of ``texts`` (``node, text``; rows may repeat) at the threshold."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = batch.take(pa.array(_new(batch.column(0).to_pylist(), seen), pa.int32()))
            texts = batch.column(1).to_pylist()
            for begin, end in _slices(texts):
                found = [rarest(own, shared.value, threshold).view(np.int64) if len(own) else None for own in shingle_sets(texts[begin:end])]
                yield pa.RecordBatch.from_pydict({"node": batch.column(0).slice(begin, end - begin).cast(pa.binary()), "rare": pa.array(found, pa.list_(pa.int64()))})

    found = texts.select("node", "text").mapInArrow(lean(work), "node binary, rare array<long>").groupBy("node").agg(F.first("rare").alias("rare"))
    rows = materialize(found.select("node", F.explode("rare").alias("bucket")))
    names = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("v"), names.alias("names")).where("n > 1")
    # Shingles that the same texts share do the same work; one of them is enough.
    counts = materialize(counts.groupBy("n", "v", "names").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "v"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = _joined(rows, counts, "bucket", total)
    close = _bucket_links(met.where(F.col("n") <= 4 * crowd).select("bucket", "node"), sketches, threshold)
    return close.unionByName(met.where((F.col("n") > 4 * crowd) & (F.col("node") != F.col("v"))).select(F.col("node").alias("u"), "v"))


def candidate_links(texts: DataFrame, threshold: float, target: float, crowd: int) -> DataFrame:
    """Links whose components hold the candidate pairs of ``texts`` (``node, text``): ``u, v``."""
    tried = lengths(threshold, target)
    sigs = materialize(signatures(texts, tried))
    links, left = forest_links(sigs, tried, threshold, target, crowd)
    if not left.isEmpty():
        left = materialize(left)
        links = links.unionByName(rare_links(_only(texts, left), sigs.select("node", "sketch"), threshold, crowd))
    return links.distinct()


def _enough(shared, union, threshold: float):
    """Whether sets that share ``shared`` of ``union`` members reach the threshold, which rounding must not take from them."""
    return shared >= threshold * union - 1e-9 * union


def _verify(sets: list[np.ndarray], left: int, within: bool, threshold: float) -> np.ndarray:
    """Index pairs with Jaccard at or above the threshold.

    ``within``: all pairs of the list; else only pairs between the first ``left`` and the rest.
    """
    sizes = np.array([len(s) for s in sets])
    if within and len(sets) <= FEW:
        found = []
        for j in range(len(sets)):
            for i in range(j):
                shared = _shared(sets[i], sets[j])
                if _enough(shared, sizes[i] + sizes[j] - shared, threshold):
                    found.append((i, j))
        return np.array(found, np.int64).reshape(-1, 2)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = (len(sets), 0) if within else (left, left)
    shared = np.zeros((a, len(sets) - b))
    width = 4096
    for first in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        shared += part[:a] @ part[b:].T
    union = sizes[:a, None] + sizes[None, b:] - shared
    i, j = np.nonzero(_enough(shared, union, threshold))
    if within:
        i, j = i[i < j], j[i < j]
    return np.stack([i, j + b], axis=1)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verified(cells: DataFrame, threshold: float) -> DataFrame:
    """``node, v, links``: per cell, the weight of each node's partners and a node its component is tied to.

    ``cells`` has ``component, blocks, i, j, block, node, weight, text``; a cell holds the blocks i and j
    of a component's ``blocks`` and is worked off as a whole, at most two blocks.
    """

    def cell(rows: list[tuple], i: int, j: int) -> Iterator[tuple[bytes, bytes, int]]:
        rows.sort(key=lambda r: (r[0] != i, r[1]))
        left = sum(r[0] == i for r in rows)
        sets = []
        texts = [r[3] for r in rows]
        for begin, end in _slices(texts):
            sets += shingle_sets(texts[begin:end])
        pairs = _verify(sets, left, i == j, threshold)
        weight = np.array([r[2] for r in rows])
        links = np.bincount(pairs[:, 0], weight[pairs[:, 1]], len(rows)) + np.bincount(pairs[:, 1], weight[pairs[:, 0]], len(rows))
        root = _linked(pairs, len(rows))
        for r, to, n in zip(rows, root, links, strict=True):
            if n:
                yield r[1], rows[to][1], int(n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            for component, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, i, j) != now:
                    if rows:
                        out += cell(rows, *now[1:])
                    now, rows = (component, i, j), []
                rows.append(tuple(row))
            if len(out) > 10_000:
                yield _as_batch(out)
                out = []
        if rows:
            out += cell(rows, *now[1:])
        yield _as_batch(out)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The cells of a component go to partitions in turn; dealt by hash, several large ones would meet.
    number = F.expr("(i * (2 * blocks - i + 1)) div 2 + j - i")
    dealt = cells.withColumn("part", F.pmod(F.hash("component").cast("long") + number, F.lit(parts)).cast("int"))
    dealt = dealt.repartitionById(parts, "part").select("component", "i", "j", "block", "node", "weight", "text")
    return dealt.sortWithinPartitions("component", "i", "j").mapInArrow(lean(work), "node binary, v binary, links long")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    nodes, roots, links = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(links, pa.int64())], ["node", "v", "links"]
    )


def node_key(text) -> F.Column:
    """128 bits of the text's digest."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _linked_nodes(texts: DataFrame, ids: DataFrame, threshold: float, target: float, crowd: int) -> DataFrame:
    """``node, n, least, links, class_node, class_least`` of each distinct text of ``texts`` (``node, text``) with the rows ``ids`` (``doc_id, node``).

    ``n`` counts its rows and ``least`` is the least doc_id of these; ``links`` is null without a
    link to another text, and so are ``class_node`` and ``class_least``, the least node and
    doc_id of its class.
    """
    nodes = materialize(ids.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    loose = materialize(connected_components(candidate_links(texts, threshold, target, crowd)).repartition("node"))
    # Ten blocks from some size on, so that its cells spread; more only where they would grow too large.
    members = F.col("n")
    blocks = F.greatest(F.ceil(members / BLOCK), F.least(F.lit(10), F.ceil(members / (BLOCK / 5))))
    sizes = materialize(loose.groupBy("component").agg(F.count("*").alias("n")).withColumn("blocks", blocks.cast("int")))
    placed = _joined(loose, sizes, "component", loose.count()).drop("n")
    placed = placed.join(nodes.select("node", F.col("n").alias("weight")), "node")
    placed = placed.withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    distinct_texts = _only(texts, loose.select("node")).groupBy("node").agg(F.first("text").alias("text"))
    cells = distinct_texts.join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = materialize(verified(cells, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = materialize(connected_components(found.select(F.col("node").alias("u"), "v").where("u != v")).repartition("node"))
    own = classes.join(nodes.select("node", "least"), "node")
    of_class = materialize(own.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("class_least")))
    classed = _joined(classes, of_class, "component", classes.count()).join(links, "node")
    classed = classed.select("node", "links", F.col("component").alias("class_node"), "class_least")
    return materialize(nodes.join(classed, "node", "left"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("text")).withColumn("node", node_key(F.col("text")))


def ngram_join(docs: DataFrame, threshold: float = 0.8, target: float = TARGET, crowd: int = 64) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links``.

    Documents are linked when their sets of five-word runs (words as in ``textkit``; a text of
    one to four words is one run) have a Jaccard similarity of at least ``threshold``, or when
    their texts are equal. ``class_id`` is the least doc_id of all documents joined by links,
    ``n_links`` the number of other documents linked to this one, copies included. A null text
    is empty; texts without a word are linked to equal texts only. A null doc_id is never the
    least unless all are null. Rows that repeat a doc_id count as documents of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    texts = _texts(docs)
    ids = materialize(texts.select("doc_id", "node"))
    known = _linked_nodes(texts, ids, threshold, target, crowd).select(
        "node",
        "n",
        F.when(F.col("class_node").isNull(), F.col("least")).otherwise(F.col("class_least")).alias("class_id"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return _joined(ids, known, "node", ids.count()).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, target: float = TARGET, crowd: int = 64) -> DataFrame:
    """The rows of ``docs`` with one document of each class left, all columns kept: the one with the least doc_id.

    A null doc_id comes last; of different texts under that doc_id the one with the least node
    stays, and of rows that repeat both one. Documents without a link stay. A null text is
    empty, an empty table stays empty, and other columns may have any name. What is decided is a
    set of doc_ids and nodes; few of them are broadcast, and then no text moves.
    """
    prepare_workers(docs.sparkSession)
    texts = _texts(docs)
    ids = materialize(texts.select("doc_id", "node"))
    known = _linked_nodes(texts, ids, threshold, target, crowd)
    class_of = F.coalesce("class_node", "node")
    first = known.groupBy(class_of.alias("c")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("first"))
    names = fresh(docs, "_key", "_node", "_lost_key", "_lost_node", "_stays")
    key, node, lost_key, lost_node, stays = names
    first = first.select(F.col("first.least").alias(key), F.col("first.node").alias(node), F.lit(True).alias(stays))
    rows = ids.groupBy(F.col("doc_id").alias(lost_key), F.col("node").alias(lost_node)).agg(F.count("*").alias("n"))
    rows = rows.join(first, F.col(lost_key).eqNullSafe(F.col(key)) & (F.col(lost_node) == F.col(node)), "left")
    rows = materialize(rows.where(F.col(stays).isNull() | (F.col("n") > 1)).select(lost_key, lost_node, stays))
    few = rows.count() <= FEW_NODES
    lost, repeated = (F.broadcast(x) if few else x for x in (rows.where(F.col(stays).isNull()), rows.where(F.col(stays))))
    same = F.col("doc_id").eqNullSafe(F.col(lost_key)) & (F.col(node) == F.col(lost_node))
    kept = docs.withColumn(node, node_key(text_of())).join(lost, same, "left_anti")
    if not rows.where(F.col(stays)).isEmpty():
        single = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", node])
        kept = kept.join(repeated, same, "left_anti").unionByName(single)
    return kept.select(*all_columns(docs))


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
