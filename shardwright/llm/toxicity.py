"""Toxicity by weak supervision.

Dozens of voters look at labelled documents: every word of the lexicons, surface patterns, and
word parts mined from the labels; those that do not favour labelled toxic documents are left
out. A generative label model groups them into families by their correlations and finds by
expectation-maximisation how reliable each voter is, how far voters repeat each other, and how
reliable the label itself is, which is one more voter of each family. It starts from whether any
voter votes and gives each document a posterior label. A linear classifier over words and word
parts is trained on the posteriors and scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import held_out, lean, materialize, prepare_workers, release_memory, table, text_of
from shardwright.llm.textkit import mix, packed_words, runs, span_hashes, words

#: Insults by language; a hit is a vote for toxic and a feature of the classifier.
LEXICONS = {
    "en": "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown retard "
    "bitch bastard asshole shit fuck fucking whore slut cunt dickhead scumbag imbecile",
    "de": "idiot idioten dumm blöd arschloch scheiße hurensohn fotze wichser schlampe abschaum dreckig trottel missgeburt",
    "fr": "idiot idiote con connard connasse salope merde pute enculé abruti débile ordure crétin batard",
    "es": "idiota estúpido imbécil mierda puta puto cabrón gilipollas pendejo basura asqueroso escoria maricón inútil",
}
#: Surface patterns that may come with insults; the label model finds out whether they do.
PATTERNS = {
    "exclaims": re.compile(r"!!!"),
    "shouts": re.compile(r"(?:\b[^\W\d_a-zß-öø-ÿ]{4,}\b\W+){4}"),
    "addresses": re.compile(r"(?i)\b(?:you are|you're|du bist|tu es|vous êtes|eres)\s+(?:such\s+)?(?:an?|ein|une?|un)\b"),
    "masks": re.compile(r"(?i)\b\w+[*@#$]+\w+\b"),
}
PART_LENGTHS = (4, 5, 7)
#: Labelled documents that train, and parts that become features, at most (about).
MAX_SAMPLE, MAX_PARTS = 12_000, 1024
#: Least likelihood ratio of a mined part (chance gives one in 100,000) and of a voter (one in 20), and most mined voters.
LEAST_G2, VOTER_G2, MAX_VOTERS = 20.0, 3.84, 64
#: Mined voters that shall reach a toxic document.
REDUNDANCY = 3
_WHOLE = np.uint64(0x5851F42D4C957F2D)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per pack of texts: hashes of all words and of all parts of words, and the text of each."""
    for sums, starts, ends, owner in packed_words(texts):
        lengths = ends - starts
        found, texts_of = [span_hashes(sums, starts, ends) ^ _WHOLE], [owner]
        offsets = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(offsets - starts, lengths)
        room, own = np.repeat(ends, lengths) - at, np.repeat(owner, lengths)
        for n in PART_LENGTHS:
            fits = room >= n
            at, room, own = at[fits], room[fits], own[fits]
            found.append(span_hashes(sums, at, at + n))
            texts_of.append(own)
        yield np.concatenate(found), np.concatenate(texts_of)


def word_hashes(listed: list[str]) -> np.ndarray:
    """The features of single words."""
    return words(listed)[0] ^ _WHOLE


class Lookup:
    """Finds which of a set of features occur in texts; a bit table spares most of the searches."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.table = np.zeros(1 << 16, bool)
        self.table[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and value of each feature found, in order of texts.

        The value is the binary logarithm of one plus the number of occurrences.
        """
        n = len(self.sorted)
        hits = [np.zeros(0, np.int64)]
        for h, own in features(texts):
            maybe = np.flatnonzero(self.table[(h >> np.uint64(48)).astype(np.int64)]) if n else []
            if len(maybe):
                h, own = h[maybe], own[maybe]
                at = np.minimum(np.searchsorted(self.sorted, h), n - 1)
                same = self.sorted[at] == h
                hits.append(own[same] * n + self.order[at[same]])
        key, count = np.unique(np.concatenate(hits), return_counts=True)
        return key // max(n, 1), key % max(n, 1), np.log2(1.0 + count)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_sample: int, seed: int) -> DataFrame:
    """``text, toxic`` of about ``max_sample`` labelled documents at most, one of each set of near copies.

    ``toxic`` is the mean of the labels of a document and its near copies. Which rows are taken
    depends on a seeded hash of the id. Rows are near copies when two minima over their
    five-word runs are the same; a text without a word has none but itself.
    """
    means = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    share = max_sample / max(1, means.count())
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = F.broadcast(means.where(draw < share))
    rows = docs.select("doc_id", text_of().alias("text")).join(taken, "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("toxic"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = runs(*words(batch.column(1).to_pylist()), 5)
            some = np.flatnonzero(np.diff(at))
            first, second = mix(np.array(batch.column(0).to_pylist(), np.int64).view(np.uint64)), np.zeros(batch.num_rows, np.uint64)
            if len(some):
                first[some] = np.minimum.reduceat(values, at[:-1][some])
                second[some] = np.minimum.reduceat(mix(values), at[:-1][some])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                ["doc_id", "text", "toxic", "first", "second"],
            )

    marked = materialize(rows.mapInArrow(lean(work), "doc_id long, text string, toxic double, first long, second long"))
    means = marked.groupBy("first", "second").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))
    return marked.drop("toxic").join(means, ["first", "second", "doc_id"]).select("doc_id", "text", "toxic").coalesce(8)


def mine_parts(sample: DataFrame, max_parts: int, held: int = 1 << 20) -> np.ndarray:
    """Words and word parts that toxic documents of the sample have far more often than others.

    Documents are counted by part on the executors, about ``held`` parts at a time; only the
    ``max_parts`` best reach the driver.
    """
    sides = sample.agg(F.count_if(F.col("toxic") >= 0.5).alias("a"), F.count_if(F.col("toxic") < 0.5).alias("b")).first()
    if not sides["a"] or not sides["b"]:
        return np.zeros(0, np.uint64)

    def counted(parts: list[np.ndarray], toxic: list[bool]) -> pa.RecordBatch:
        h, at = np.unique(np.concatenate(parts), return_inverse=True)
        of_toxic = np.repeat(toxic, [len(x) for x in parts])
        a = np.bincount(at[of_toxic], minlength=len(h))
        return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "a": pa.array(a, pa.int64()), "b": pa.array(np.bincount(at, minlength=len(h)) - a, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, toxic, n = [], [], 0
        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in features([text])]])))
                toxic.append(mark >= 0.5)
                n += len(parts[-1])
                if n >= held:
                    yield counted(parts, toxic)
                    parts, toxic, n = [], [], 0
        if parts:
            yield counted(parts, toxic)

    sums = sample.select("text", "toxic").mapInArrow(lean(count), "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    g2 = _ratio_column(F.col("a"), F.col("b"), sides["a"], sides["b"])
    best = sums.where("a > 0").select("h", g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "h").limit(max_parts)
    return np.array([r["h"] for r in best.select("h").collect()], np.int64).view(np.uint64)


def _ratio_column(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """``_likelihood_ratio`` as a column."""
    n, both = n_a + n_b, a + b
    total = F.lit(0.0)
    for cell, row, column in ((a, both, n_a), (b, both, n_b), (n_a - a, n - both, n_a), (n_b - b, n - both, n_b)):
        total = total + F.when(cell > 0, cell * F.log(cell * n / (row * F.lit(float(column))))).otherwise(0.0)
    return F.when(a * n_b > b * n_a, 2 * total).otherwise(-2 * total)


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Signed G-squared of presence in two samples; positive where the first has it more often."""
    cells = np.stack([a, b, n_a - a, n_b - b]).astype(float)
    rows, columns = np.stack([a + b, a + b, n_a + n_b - a - b, n_a + n_b - a - b]), np.array([n_a, n_b, n_a, n_b])[:, None]
    expected = rows * columns / (n_a + n_b)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(cells > 0, cells * np.log(cells / expected), 0.0)
    return 2 * terms.sum(axis=0) * np.sign(a / n_a - b / n_b)


def families(votes: np.ndarray, least: float = 0.1) -> np.ndarray:
    """The family of each voter: voters that go together (a correlation of ``least`` at least, also by way of others) share one."""
    spread = votes - votes.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    close = spread.T @ spread / np.outer(norm, norm) >= least
    family = np.arange(votes.shape[1])
    for _ in range(len(family)):
        least_of = np.array([family[near | (np.arange(len(family)) == i)].min() for i, near in enumerate(close)], int)
        if (least_of == family).all():
            break
        family = least_of
    return np.unique(family, return_inverse=True)[1]


def label_model(
    votes: np.ndarray, label: np.ndarray | None = None, start: np.ndarray | None = None, rounds: int = 30, correlated: bool = True
) -> tuple[np.ndarray, dict]:
    """Posterior probability of toxic for each row of 0/1 ``votes``, and what the model found.

    Voters that go together form a family with a hidden cause of its own (insults of one
    language, say), so silence of one family is no evidence against another. A row is toxic
    when any cause is at work, which the causes' posteriors give as a noisy or. Within a family
    expectation-maximisation finds each voter's rate of voting with and without the cause (its
    accuracies) and the correlations left between voters; a voter's evidence is divided by one
    plus its correlations with the others (unless ``correlated`` is false), so a clique counts
    about once. ``label``, if given, is a further voter of every family. ``start`` holds first
    guesses; without them, whether any voter of the family votes (the label apart). Without a
    voter the label alone decides, and without both nothing is toxic. ``label_rates`` are those
    of the label by family.
    """
    n, m = votes.shape
    family = families(votes)
    clean, rates, dependence, prior, label_rates = np.ones(n), np.zeros((2, m)), np.zeros((m, m)), [], []
    for f in range(int(family.max(initial=-1)) + 1):
        own = np.flatnonzero(family == f)
        cast = votes[:, own] if label is None else np.column_stack([votes[:, own], label])
        p, found = _cause(cast, votes[:, own].max(axis=1) if start is None else start, rounds, correlated)
        clean *= 1 - p
        rates[:, own], dependence[np.ix_(own, own)] = found["rates"][:, : len(own)], found["dependence"][: len(own), : len(own)]
        prior.append(found["prior"])
        label_rates.append(found["rates"][:, -1])
    if not m and label is not None:
        clean = 1.0 - label
    return 1 - clean, {"rates": rates, "dependence": dependence, "prior": np.array(prior), "family": family, "label_rates": np.array(label_rates)}


def _cause(votes: np.ndarray, start: np.ndarray, rounds: int, correlated: bool) -> tuple[np.ndarray, dict]:
    """The posterior of one family's cause for each row, by expectation-maximisation."""
    p = np.clip(start.astype(float), 0.02, 0.98)
    rates, dependence = None, None
    for _ in range(rounds):
        on, off = p.sum(), (1 - p).sum()
        rates = np.stack([((1 - p) @ votes + 0.5) / (off + 1), (p @ votes + 0.5) / (on + 1)])
        prior = (on + 0.5) / (on + off + 1)
        residual = votes - (p[:, None] * rates[1] + (1 - p)[:, None] * rates[0])
        spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
        dependence = np.clip(residual.T @ residual / len(votes) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(dependence, 0)
        dependence[dependence < 0.1] = 0
        dependence *= correlated
        weight = 1 / (1 + dependence.sum(axis=1))
        yes, no = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        score = np.log(prior / (1 - prior)) + votes @ (weight * yes) + (1 - votes) @ (weight * no)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, {"rates": rates, "dependence": dependence, "prior": prior}


def _cover(hits: np.ndarray, toxic: np.ndarray, most: int) -> list[int]:
    """Columns of ``hits`` that together reach the toxic rows ``REDUNDANCY`` times, the most telling on what is left first.

    A column gains the toxic rows that still lack voters less three times the others that it
    has; one that gains fewer than three ends the search.
    """
    lacking, chosen = np.where(toxic, REDUNDANCY, 0), []
    while len(chosen) < min(most, hits.shape[1]):
        gain = hits[lacking > 0].sum(axis=0) - 3.0 * hits[~toxic].sum(axis=0)
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] < 3:
            break
        chosen.append(best)
        lacking -= hits[:, best]
    return chosen


def cast_votes(seen: np.ndarray, n_fixed: int, marks: np.ndarray, human: np.ndarray) -> np.ndarray:
    """The votes of all voters but the label, a column each: lexicon words, patterns and mined parts.

    Words and patterns that the labels do not favour (``VOTER_G2``) have no vote.
    """
    known = np.concatenate([seen[:, :n_fixed], marks], axis=1)
    a, b = known[human].sum(axis=0), known[~human].sum(axis=0)
    favoured = np.zeros(known.shape[1], bool)
    if human.any() and not human.all():
        favoured = _likelihood_ratio(a, b, int(human.sum()), int((~human).sum())) >= VOTER_G2
    mined = seen[:, n_fixed:]
    return np.concatenate([known[:, favoured], mined[:, _cover(mined.astype(int), human, MAX_VOTERS)]], axis=1).astype(np.float64)


def _largest_square(x: np.ndarray, rounds: int = 30) -> float:
    """The square of the largest singular value, a little over, by power iteration."""
    v = np.ones(x.shape[1], np.float32)
    square = 0.0
    for _ in range(rounds):
        v = x.T @ (x @ v)
        square = float(np.linalg.norm(v))
        if not square:
            return 0.0
        v /= square
    return 1.1 * square


def train_linear(hits: np.ndarray, target: np.ndarray, penalty: float = 0.01, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, with a squared penalty."""
    x, n = hits.astype(np.float32, copy=False), len(target)
    w, bias = np.zeros(x.shape[1]), float(np.log((target.mean() + 1e-3) / (1.001 - target.mean())))
    step = 4.0 / (1.0 + _largest_square(x) / max(n, 1) + 4 * penalty / max(n, 1))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + ahead_bias, -30, 30)))
        error = (p - target).astype(np.float32)
        new = ahead - step * ((x.T @ error) / n + penalty / n * ahead)
        new_bias = ahead_bias - step * float(error.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def fit(
    docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, max_parts: int = MAX_PARTS, seed: int = 0, label_votes: bool = True
) -> Model:
    """Train on ``labels`` (``doc_id, toxic``) and the texts of their documents.

    Null labels and ids are left out, a null text is empty, repeated labels of a document are
    averaged, other columns of either table are ignored. ``label_votes`` tells whether the label
    is a voter or only chooses voters. A lexicon word that the sample does not
    hold weighs as much as those that it holds do on average. With no labelled document, and so
    for an empty table, the lexicons alone decide.
    """
    prepare_workers(docs.sparkSession)
    listed = [w for text in LEXICONS.values() for w in text.split()]
    fixed = np.unique(word_hashes(listed)) if listed else np.zeros(0, np.uint64)
    sample = labelled_sample(docs, labels, max_sample, seed)
    mined = np.setdiff1d(mine_parts(sample, max_parts), fixed)
    hashes = np.concatenate([fixed, mined])
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own, feature, value = lookup.present(texts)
            ends = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
            marks = [[bool(p.search(t)) for p in PATTERNS.values()] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value)), pa.array(marks, pa.list_(pa.bool_()))],
                ["doc_id", "toxic", "hits", "values", "marks"],
            )

    schema = "doc_id long, toxic double, hits array<int>, values array<double>, marks array<boolean>"
    rows = sample.mapInArrow(lean(look), schema).toArrow().sort_by("doc_id")
    n = rows.num_rows
    if not n:
        return Model(hashes, np.full(len(hashes), 4.0), -2.0)
    hits = np.zeros((n, len(hashes)), np.float32)
    for i, (own, values) in enumerate(zip(rows["hits"].to_pylist(), rows["values"].to_pylist(), strict=True)):
        hits[i, own] = values
    human = rows["toxic"].to_numpy() >= 0.5
    seen = hits > 0
    votes = cast_votes(seen, len(fixed), np.array(rows["marks"].to_pylist(), bool), human)
    posterior, _ = label_model(votes, human if label_votes else None)
    weights, bias = train_linear(hits, posterior)
    known = seen[:, : len(fixed)].any(axis=0)
    weights[: len(fixed)][~known] = weights[: len(fixed)][known].mean() if known.any() else 0.0
    model = Model(hashes, weights, bias)
    del rows, hits, seen, votes
    release_memory()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; a null text is scored as the empty one.

    The score is the classifier's probability of the label 1; ``predicted`` is 1 from 0.5 on.
    An empty table gives an empty result; other columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lookup = Lookup(known.hashes)
        for batch in batches:
            own, feature, value = lookup.present(batch.column(1).to_pylist())
            sums = np.bincount(own, known.weights[feature] * value, minlength=batch.num_rows) + known.bias
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32))}
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(work), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below 0.5, all columns kept; scored where they lie.

    A null text is scored as the empty one, rows that repeat are scored each, an empty table
    stays empty, and other columns may have any name.
    """
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lookup = Lookup(known.hashes)
        for batch in batches:
            own, feature, value = lookup.present([t or "" for t in batch.column(at).to_pylist()])
            sums = np.bincount(own, known.weights[feature] * value, minlength=batch.num_rows) + known.bias
            yield batch.filter(pa.array(sums < 0))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever characters a name holds
    return plain.mapInArrow(lean(work), plain.schema).toDF(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels.where(~held_out(5, 0))))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
