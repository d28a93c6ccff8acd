"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from helpers import assert_same
from shardwright.llm import toxicity
from shardwright.llm.common import held_out
from shardwright.llm.queries import QUERIES, SQL
from tests_brute import connected, linked_pairs, water_fill


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_a_row_per_document(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert {r["doc_id"] for r in docs.collect()} <= ids
        ids = {r["doc_id"] for r in docs.collect()}
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if i in (1, 2):
            assert docs.select("text").distinct().count() == docs.count()
    assert docs.where("NOT parity OR NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with repeated and null ids, copies, a group of near copies above the size of a crowd, and toxic texts; and their labels."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "ta", "so"]) for _ in range(rng.randint(2, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rng.randint(5, 150)), f"s{i % 3}") for i in range(150)]
    rows = [(i, t + " zwork idiot moron scum" if i % 9 == 0 else t, s) for i, t, s in rows]
    base = text(120)
    rows += [(1000 + i, f"{base} end{i}", "s1") for i in range(80)]
    rows += [(2000 + i, "the very same text again and again", "s2") for i in range(40)]
    rows += [(5, text(30), "s0"), (5, text(30), None), (None, text(40), "s0"), (None, text(40), None), (None, rows[1][1], "s0"), (7, None, "s1"), (8, "", "s1"), (9, " ", None)]
    rows += [rows[3], rows[3]]
    folder = tmp_path_factory.mktemp("corpus")
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 9 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, str(folder)


def kept_rows(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_toxicity_stage_drops_what_the_score_rejects(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(5, 0))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    kept = kept_rows(corpus_pipeline.remove_toxic(spark, docs, folder))
    assert sum(kept.values()) == scored.where("predicted = 0").count()
    lost = Counter(rows) - kept
    assert {t.endswith("scum") for _, t, _ in lost} == {True} and sum(lost.values()) == sum((t or "").endswith("scum") for _, t, _ in rows)


def test_exact_stage_is_brute_force(spark, corpus):
    rows, folder = corpus
    kept = kept_rows(corpus_pipeline.remove_exact_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    best = {}
    for i, t, _ in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sum(kept.values()) == len(best)
    assert all(best[t or ""] == (-1 if i is None else i) for i, t, _ in kept)


def test_join_stage_is_brute_force(spark, corpus):
    rows, folder = corpus
    kept = kept_rows(corpus_pipeline.remove_near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    root = connected(linked_pairs([t for _, t, _ in rows]))
    classes = {}
    for place, (i, t, _) in enumerate(rows):
        classes.setdefault(root.get(place, place), []).append((i is None, i, t))
    assert sum(kept.values()) == len(classes)
    found = {}
    for i, t, _ in kept:
        own = [c for c, members in classes.items() if (i is None, i, t) in members]
        assert len(own) == 1 and own[0] not in found
        found[own[0]] = (i is None, i or 0)
    assert all(found[c] == min((none, i or 0) for none, i, _ in members) for c, members in classes.items())
    assert sum(i is not None and 1000 <= i < 1080 for i, _, _ in kept) == 1


def test_mixing_stage_is_near_its_targets(spark, corpus):
    rows, folder = corpus
    mixed = kept_rows(corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    size = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    for (_, t, s), n in mixed.items():
        taken[s] += n * size(t)
    expected = water_fill(dict(sizes))
    assert set(mixed) <= set(rows) and all(n <= 2 * Counter(rows)[row] for row, n in mixed.items())
    assert all(abs(taken[s] - expected[s]) <= 0.05 * expected[s] + 30 for s in sizes)


def test_encoding_stage_covers_every_row(spark, corpus):
    rows, folder = corpus
    got = corpus_pipeline.encode(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t, _ in rows)
    assert all(r["parity"] and r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in got)


def test_run_gives_a_row_of_the_mix_for_each(spark, corpus):
    rows, folder = corpus
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.collect()} <= {i for i, _, _ in rows} and got.count() > 0
