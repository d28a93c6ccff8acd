"""Language identification and toxicity on made-up labelled texts; label models by themselves."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shardwright.llm.common import held_out
from shardwright.llm.langid import UNDETERMINED, fit, fit_temperature, identify, predict_texts, text_counts
from shardwright.llm.toxicity import drop_toxic, label_model, score
from shardwright.llm.toxicity import fit as fit_toxicity

SYLLABLES = {"aa": "the ing tion ed and er", "bb": "der ein sch ung lich keit", "cc": "los ción mente ado que ez"}


def sentence(lang, rng, n=40):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_of_unseen_texts(spark, awkward, nothing):
    rng = random.Random(0)
    rows = [(i, sentence(lang, rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(learn)
    fresh = [(sentence(lang, rng), lang) for lang in ["aa", "bb", "cc"] * 30]
    langs, scores = predict_texts(model, [t for t, _ in fresh])
    assert np.mean([a == b for a, (_, b) in zip(langs, fresh)]) > 0.97
    assert all(0 < s <= 1 for s in scores)
    assert predict_texts(model, [None, "", "12 !?"])[0] == [UNDETERMINED] * 3
    assert (np.asarray(model.weights) == 0).mean() > 0.5
    got = identify(awkward, model)
    assert got.count() == awkward.count() and got.where("lang_pred = 'und'").count() == 4
    assert identify(nothing, model).count() == 0
    assert fit(learn.where("text IS NULL")) is None
    assert identify(awkward, None).where("lang_pred != 'und'").count() == 0


def test_gram_counts_do_not_depend_on_packing():
    rng = random.Random(1)
    long = sentence("aa", rng, 200_000)
    texts = [sentence("bb", rng), "", long, "x", long[:1000]]
    together = {i: (a.tolist(), b.tolist()) for i, a, b in text_counts(texts)}
    for i, t in enumerate(texts):
        alone = [(a.tolist(), b.tolist()) for _, a, b in text_counts([t])]
        assert alone == ([together[i]] if i in together else [])


def test_temperature():
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1, 1, 1], 4000)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(fit_temperature(np.log(p) * 3, labels) - 3) < 0.3


def test_held_out(spark):
    rows = spark.range(-5, 60).withColumnRenamed("id", "doc_id").select("doc_id", held_out(4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_toxicity_learns_unknown_words(spark, awkward, nothing):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        toxic = i % 8 == 0
        words = sentence("bb", rng, 50).split()
        if toxic:
            for _ in range(4):
                words[rng.randrange(50)] = "zwork" + rng.choice(["ung", "lich", "sch"])
        rows.append((i, " ".join(words), int(toxic)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = data.select("doc_id", "toxic").where("doc_id % 3 > 0").withColumn("text", data["doc_id"].cast("string"))
    model = fit_toxicity(data.select("doc_id", "text"), labels)
    got = score(data, model).join(data, "doc_id").toPandas()
    unseen = got[got["doc_id"] % 3 == 0]
    assert (unseen["predicted"] == unseen["toxic"]).mean() > 0.97
    assert got["score"].between(0, 1).all()
    assert drop_toxic(data, model).count() == int((got["predicted"] == 0).sum())
    assert score(awkward, model).where("predicted = 1").count() == 0
    assert drop_toxic(awkward, model).columns == awkward.columns
    assert score(nothing, model).count() == drop_toxic(nothing, model).count() == 0
    without = fit_toxicity(data.select("doc_id", "text"), labels.limit(0))
    found = score(spark.createDataFrame([(1, "you idiot, you scum"), (2, "a fine day"), (3, None)], "doc_id long, text string"), without)
    assert [r["predicted"] for r in found.orderBy("doc_id").collect()] == [1, 0, 0]


def test_label_model_weighs_voters():
    rng = np.random.default_rng(3)
    truth = rng.random(5000) < 0.3
    good, fair, other, poor = (np.where(rng.random(5000) < a, truth, ~truth) for a in (0.95, 0.85, 0.85, 0.6))
    votes = np.stack([good, fair, other, poor, poor, poor], axis=1).astype(float)
    posterior, found = label_model(votes, start=votes.mean(axis=1))
    assert ((posterior > 0.5) == truth).mean() > 0.93
    assert found["dependence"][3, 4] > 0.8 and found["dependence"][0, 1] < 0.3
    assert found["rates"][1, 0] > found["rates"][1, 1] > found["rates"][1, 3]


def test_held_out_accuracy_on_the_tables(spark):
    """At sf0.01 the language of documents that took no part in the learning is found for nearly all."""
    from pathlib import Path

    from shardwright.llm.langid import op1_language_id

    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    unseen = op1_language_id(spark, folder).where("held_out").join(docs, "doc_id").toPandas()
    assert (unseen["lang_pred"] == unseen["lang"]).mean() > 0.97


def test_posterior_is_bayes_rule_on_every_pattern():
    """All eight patterns of three voters that do not repeat each other, against Bayes' rule written out."""
    patterns = [[i >> j & 1 for j in range(3)] for i in range(8)]
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.2
    votes = np.stack([np.where(truth, rng.random(20_000) < a, rng.random(20_000) < b) for a, b in ((0.9, 0.05), (0.7, 0.02), (0.6, 0.1))], axis=1).astype(float)
    posterior, found = label_model(votes, rounds=400)
    assert found["prior"] == pytest.approx([0.2], abs=0.02) and not found["dependence"].any()
    for pattern in patterns:
        yes, no = found["prior"][0], 1 - found["prior"][0]
        for j, v in enumerate(pattern):
            yes *= found["rates"][1, j] if v else 1 - found["rates"][1, j]
            no *= found["rates"][0, j] if v else 1 - found["rates"][0, j]
        own = posterior[(votes == pattern).all(axis=1)]
        assert np.allclose(own, yes / (yes + no), atol=1e-3)


def test_correlations_change_posteriors():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    good, other, echo = (np.where(truth, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.9, 0.02), (0.85, 0.03), (0.5, 0.2)))
    votes = np.stack([good, other, *[echo] * 6], axis=1).astype(float)
    with_, without = label_model(votes)[0], label_model(votes, correlated=False)[0]
    assert ((with_ > 0.5) == truth).mean() > ((without > 0.5) == truth).mean() + 0.05


def test_mined_parts_are_brute_force(spark):
    """Counts by part on the executors, in small pieces, against counts of the whole sample in one."""
    from shardwright.llm.toxicity import LEAST_G2, _likelihood_ratio, features, mine_parts

    rng = random.Random(7)
    rows = [(i, sentence("bb", rng, 20) + (" grblwort" if i % 4 == 0 and i % 20 else ""), float(i % 4 == 0)) for i in range(240)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic double").repartition(3)
    sides = [[], []]
    for _, text, toxic in rows:
        sides[int(toxic)] += np.unique(np.concatenate([h for h, _ in features([text])])).tolist()
    b, a = (dict(zip(*(x.tolist() for x in np.unique(np.array(s, np.uint64), return_counts=True)))) for s in sides)
    ratio = {h: _likelihood_ratio(np.array([n]), np.array([b.get(h, 0)]), 60, 180)[0] for h, n in a.items()}
    expected = {h for h, g in ratio.items() if g >= LEAST_G2}
    assert expected and set(mine_parts(sample, 10_000, held=500).tolist()) == expected
    assert len(mine_parts(sample, 2)) == 2
    assert len(mine_parts(sample.where("toxic < 0.5"), 10)) == 0


def auc(scores, truth):
    """The share of pairs in the right order."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n = truth.sum()
    return (ranks[truth].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_toxicity_without_lexicons(spark, monkeypatch):
    """Voters mined from the labels carry the method by themselves, and no voter is the answer."""
    from pathlib import Path

    from shardwright.llm import toxicity

    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables here")
    models = []
    kept = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda votes, label: models.append((votes, label, kept(votes, label))) or models[-1][2])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for lexicons, label_votes, least in ((toxicity.LEXICONS, True, 0.97), ({}, True, 0.95), (toxicity.LEXICONS, False, 0.95)):
        monkeypatch.setattr(toxicity, "LEXICONS", lexicons)
        model = toxicity.fit(docs, labels.where(~held_out(5, 0)), label_votes=label_votes)
        got = score(docs, model).join(labels.where(held_out(5, 0)).select("doc_id", "toxic"), "doc_id").toPandas()
        assert auc(got["score"].to_numpy(), got["toxic"].to_numpy() == 1) > least
        assert got[got["toxic"] == 0]["predicted"].mean() < 0.01
        votes, label, (posterior, found) = models[-1]
        assert votes.shape[1] >= 24 and len(set(found["family"])) > 1
        assert ((votes > 0.5) == (posterior > 0.5)[:, None]).mean(axis=0).max() < 0.99
        if label_votes:  # labels without any other voter's support are found to be noise
            assert 0 < ((posterior < 0.5) & label).sum() < 0.2 * label.sum()


def test_label_is_overruled():
    """A label that no other voter bears out is less credible than one that several do."""
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.1
    votes = np.stack([np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.01) for _ in range(5)], axis=1).astype(float)
    label = truth ^ (rng.random(4000) < 0.03)
    posterior, found = label_model(votes, label)
    assert ((posterior > 0.5) == truth).mean() > 0.995 > (label == truth).mean()
    assert found["label_rates"][0, 1] > 0.9 and found["label_rates"][0, 0] < 0.06


def plain_grams(text, most=4):
    """Counts of n-grams of letters, every run of other characters after a word being one blank, by slices of a string."""
    from collections import Counter

    line = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = "".join(w + " " for w in line.split())
    found = Counter()
    for n in range(1, most + 1):
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if " " not in gram[1:-1] and gram != " ":
                found[gram] += 1
    return found


def plain_feature(gram):
    """The place of an n-gram, by whole numbers."""
    h = 0
    for c in gram:
        h = (h * 0x100000001B3 + ord(c)) % 2**64
    h = (h + len(gram)) % 2**64
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
    return (h ^ h >> 31) >> 48


def test_grams_and_document_frequencies_are_brute_force(spark):
    from shardwright.llm.langid import document_frequencies

    rng = random.Random(8)
    texts = ["Hello, wörld! é  ü", "a", "ab c", "12 !?", "", None, "x1y2 z", sentence("cc", rng), sentence("aa", rng, 5000)]
    got = {i: dict(zip(a.tolist(), b.tolist())) for i, a, b in text_counts([t or "" for t in texts])}
    frequencies = {}
    for i, text in enumerate(texts):
        expected = {}
        for gram, n in plain_grams(text).items():
            expected[plain_feature(gram)] = expected.get(plain_feature(gram), 0) + n
        assert got.get(i, {}) == expected
        for feature in expected:
            frequencies[feature] = frequencies.get(feature, 0) + 1
    found, total = document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert total == 6 and {int(f): int(found[f]) for f in np.flatnonzero(found)} == frequencies


def test_ftrl_step_by_hand():
    """One row and one epoch: weights start at zero, so the gradient is the value times the error of an even guess."""
    from shardwright.llm.langid import train_ftrl

    w, bias = train_ftrl([(np.array([3, 7]), np.array([2.0, 0.01]), 1)], 2, epochs=1, alpha=0.5, beta=1.0, l1=0.01, l2=0.1)
    for feature, x in ((3, 2.0), (7, 0.01)):
        for c, error in ((0, 0.5), (1, -0.5)):
            g = x * error
            z, n = g, g * g
            expected = 0.0 if abs(z) <= 0.01 else -(z - np.sign(z) * 0.01) / ((1 + np.sqrt(n)) / 0.5 + 0.1)
            assert np.isclose(w[feature, c], expected)
    assert np.allclose(bias, [-0.5 / (1.5 / 0.5), 0.5 / (1.5 / 0.5)]) and np.count_nonzero(w) == 2


def test_letters_beyond_the_sample(spark):
    """Texts without a letter do not thin the sample, and a table of such texts teaches nothing."""
    rows = [(i, "12 !?", "aa") for i in range(400)] + [(1000 + i, f"the ring {i}", "aa") for i in range(4)] + [(2000 + i, f"der schluss {i}", "bb") for i in range(4)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(learn, max_sample=40)
    assert predict_texts(model, ["the ring", "der schluss"])[0] == ["aa", "bb"]
    assert fit(learn.where("doc_id < 1000")) is None
