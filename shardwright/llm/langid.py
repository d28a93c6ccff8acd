"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (1 to ``MAX_N`` letters) of the lower-cased text, in which every run
of other characters counts as one blank. A value is the n-gram's share of the text times its
inverse document frequency over all learning documents. Weights come from
follow-the-regularised-leader with elastic-net penalties, which leaves most of them at zero;
a temperature fitted on learning documents set aside calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import held_out, lean, prepare_workers, table, text_of
from shardwright.llm.textkit import code_points, mix, packs

MAX_N = 4
BITS = 16
WIDTH = 1 << BITS
#: Text without a language: null, or without any letter.
UNDETERMINED = "und"
#: At most about so many labelled documents train the weights; document frequencies use all.
MAX_SAMPLE = 6000

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        letters = np.zeros(0x110000, bool)
        letters[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _LETTERS = letters
    return _LETTERS


def grams(joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every n-gram in a pack of texts, the part it lies in, and each part's letters."""
    points = code_points(joined + "\n")
    letter = _letters()[points]
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)  # a part ends with its line feed
    n_letters = np.bincount(owner[letter], minlength=len(lengths))
    keep = letter.copy()  # a blank stays where a letter comes before it
    keep[1:] |= letter[:-1]
    kept = np.flatnonzero(keep)
    values = np.where(letter[kept], points[kept], 32).astype(np.uint64)
    part = owner[kept]
    blank = ~letter[kept]
    found, parts = [], []
    rolling = np.zeros(len(kept), np.uint64)
    inner = np.zeros(len(kept), bool)
    for n in range(1, MAX_N + 1):
        m = len(kept) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint64(0x100000001B3) + values[n - 1 :]
        # Words end at blanks: no n-gram has one inside, but it may begin or end with one.
        inner = inner[:m] | (blank[n - 2 : n - 2 + m] if n > 2 else False)
        whole = (part[:m] == part[n - 1 :]) & ~inner
        if n == 1:
            whole &= ~blank
        found.append((mix(rolling[whole] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        parts.append(part[:m][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    return np.concatenate(found), np.concatenate(parts), n_letters


def text_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text with a letter: its number, its distinct features, and how often each occurs."""
    open_text, open_counts = -1, None  # a text whose parts may go on in the next pack
    for owners, lengths, joined in packs(texts):
        feature, part, _ = grams(joined, lengths)
        order = np.argsort(part, kind="stable")
        feature, bounds = feature[order], np.searchsorted(part[order], np.arange(len(lengths) + 1))
        for k, i in enumerate(owners):
            if i != open_text:
                if open_counts is not None:
                    yield open_text, *_nonzero(open_counts)
                open_text, open_counts = i, None
            own = feature[bounds[k] : bounds[k + 1]]
            if len(own):
                counts = np.bincount(own, minlength=WIDTH)
                open_counts = counts if open_counts is None else open_counts + counts
    if open_counts is not None:
        yield open_text, *_nonzero(open_counts)


def _nonzero(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Weights already hold each feature's inverse document frequency."""

    languages: list[str]
    weights: np.ndarray  # WIDTH x languages, float32
    bias: np.ndarray
    temperature: float


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.005,
    l2: float = 0.005,
    seed: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (features, values, class) rows; returns weights and bias.

    The last row of the state is the bias, which is not penalised.
    """
    z = np.zeros((WIDTH + 1, classes))
    n = np.zeros((WIDTH + 1, classes))
    l1s, l2s = np.full((WIDTH + 1, 1), l1), np.full((WIDTH + 1, 1), l2)
    l1s[WIDTH] = l2s[WIDTH] = 0.0

    def weights(at):
        zs, ns = z[at], n[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1s[at], 0.0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2s[at])

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            feature, value, label = rows[r]
            at, x = np.append(feature, WIDTH), np.append(value, 1.0)
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            squared = g * g
            sigma = (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += squared
    w = weights(np.arange(WIDTH + 1))
    return w[:WIDTH], w[WIDTH]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by a golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many have a letter; all rows of ``docs`` count.

    A task sends one row per feature it has seen, summed by feature; the result has ``WIDTH``
    entries at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for _, features, _ in text_counts(batch.column(0).to_pylist()):
                sums[features] += 1
                rows += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(sums[at], rows), pa.int64())}
        )

    counted = docs.select(text_of().alias("text")).mapInArrow(lean(count), "feature long, n long")
    found = np.zeros(WIDTH, np.int64)
    total = 0
    for feature, n in counted.groupBy("feature").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        if feature < 0:
            total = int(n)
        else:
            found[feature] = n
    return found, total


def fit(learn: DataFrame, max_sample: int = MAX_SAMPLE, seed: int = 0) -> Model | None:
    """Train on ``learn`` (``doc_id, text, lang``, no null lang); None if no text has a letter.

    Rows that repeat count each, a null text has no letter, other columns are ignored. Document frequencies come from all rows. Weights come from at most about ``max_sample``
    rows, the same number for each language where there are enough, picked by seeded hash.
    """
    frequencies, total = document_frequencies(learn)
    if not total:
        return None
    learn = learn.where(text_of().rlike(r"\p{L}"))  # the rest would only thin the sample
    per_lang = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    languages = sorted(per_lang)
    left, share = max_sample, {}
    for i, lang in enumerate(sorted(languages, key=lambda x: per_lang[x])):
        share[lang] = min(1.0, left / (len(languages) - i) / per_lang[lang])
        left -= min(left / (len(languages) - i), per_lang[lang])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picks = F.create_map(*[x for lang, p in share.items() for x in (F.lit(lang), F.lit(p))])
    sample = learn.where(draw < F.element_at(picks, F.col("lang"))).select("doc_id", text_of().alias("text"), "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs = (batch.column(i).to_pylist() for i in range(3))
            for i, features, counts in text_counts(texts):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([ids[i]], pa.int64()),
                        "lang": pa.array([langs[i]], pa.string()),
                        "features": pa.array([features], pa.list_(pa.int32())),
                        "counts": pa.array([counts], pa.list_(pa.int32())),
                    }
                )

    taken = sample.mapInArrow(lean(count), "doc_id long, lang string, features array<int>, counts array<int>")
    rows = taken.toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending")]).combine_chunks()
    idf = np.log((1 + total) / (1 + frequencies)) + 1.0
    number = {lang: i for i, lang in enumerate(languages)}
    data = []
    for lang, features, counts in zip(rows["lang"], rows["features"], rows["counts"], strict=True):
        at, n = features.values.to_numpy(), counts.values.to_numpy()
        data.append((at, (SCALE * n / n.sum() * idf[at]).astype(np.float32), number[lang.as_py()]))
    if not data:  # letters that only one of the two tests for them knows
        return None
    calibration, training = data[::5], [x for i, x in enumerate(data) if i % 5]
    weights, bias = train_ftrl(training or data, len(languages), seed=seed)
    scores = np.array([x @ weights[at] + bias for at, x, _ in calibration])
    temperature = fit_temperature(scores, np.array([y for _, _, y in calibration]))
    return Model(languages, (weights * (SCALE * idf)[:, None]).astype(np.float32), bias, temperature)


#: Values are shares of a text; this brings them to a size at which the penalties mean something.
SCALE = 20.0


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text and its calibrated probability; texts without letters: 0."""
    given = [t or "" for t in texts]
    k = len(model.languages)
    sums, totals, letters = np.zeros((len(given), k)), np.zeros(len(given)), np.zeros(len(given), np.int64)
    for owners, lengths, joined in packs(given):
        feature, part, n_letters = grams(joined, lengths)
        for c in range(k):
            sums[:, c] += np.bincount(owners[part], np.ascontiguousarray(model.weights[:, c])[feature], minlength=len(given))
        totals += np.bincount(owners[part], minlength=len(given))
        np.add.at(letters, owners, n_letters)
    scores = (sums / np.maximum(totals, 1)[:, None] + model.bias) / model.temperature
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    known = letters > 0
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)], [
        float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known, strict=True))
    ]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there
    is no model. An empty table gives an empty result; other columns are ignored.
    """
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = predict_texts(known, texts) if known else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).cast(pa.int64()),
                    "lang_pred": pa.array(langs, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(lean(work), "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prepare_workers(spark)
    learn = docs.where(~held_out(4, 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    found = identify(docs, fit(learn))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
