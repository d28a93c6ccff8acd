"""Exact dedup and mixing against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shardwright.llm.exact_dedup import drop_exact_copies, exact_dedup
from shardwright.llm.mixing import mix_documents, mix_table, word_count
from tests_brute import water_fill


def test_exact_dedup_is_brute_force(awkward, spark):
    for share in (0.001, 0.1, 1.0):
        got = exact_dedup(awkward, heavy_share=share).collect()
        groups = defaultdict(list)
        for r in awkward.collect():
            groups[r["text"] or ""].append(r["doc_id"])
        assert len(got) == awkward.count()
        digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        kept = defaultdict(int)
        for r in got:
            ids = digest[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
            kept[r["text_sha256"]] += r["kept"]
        assert set(kept.values()) == {1}


def test_hot_group_and_repeated_rows(spark):
    rows = [(1, "hot")] * 500 + [(i, f"t{i}") for i in range(200)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), heavy_share=0.01)
    assert got.where("kept").count() == 201
    assert got.where("kept AND group_size = 500").count() == 1


@pytest.mark.parametrize("few", [500_000, 0])
def test_drop_exact_copies(awkward, nothing, monkeypatch, few):
    monkeypatch.setattr("shardwright.llm.exact_dedup.FEW_LOST", few)
    for share in (0.001, 0.1, 1.0):
        kept = drop_exact_copies(awkward, share)
        assert kept.columns == awkward.columns
        assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3, 4, 5, 7, 8, 9, 10, 12]
        assert {r["_lost"] for r in kept.collect()} == {"clash"}
    assert drop_exact_copies(nothing).count() == exact_dedup(nothing).count() == 0


def test_mixing_keeps_to_targets(spark):
    rows = [(i, "w " * (1 + i * i % 37), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_table(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by_source = got.groupby("source", dropna=False)
    sizes = {None if k != k else k: int(g["size"].sum()) for k, g in by_source}
    expected = water_fill(sizes)
    for k, g in by_source:
        k = None if k != k else k
        assert g["source_size"].eq(sizes[k]).all() and g["target"].iloc[0] == pytest.approx(expected[k])
        assert abs(g["taken"].sum() - expected[k]) <= 10
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mix_table(docs.repartition(5)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_mixing_awkward_rows(awkward, nothing):
    got = mix_table(awkward)
    assert got.count() == awkward.count() and got.where("doc_id = 1 AND size = 0 AND taken = 0").count() == 1
    mixed = mix_documents(awkward)
    assert mixed.columns == awkward.columns and mixed.where("_words != 'clash' OR `a.b` != 'clash'").count() == 0
    taken = got.groupBy().sum("taken").first()[0]
    assert mixed.select(word_count(mixed["text"]).alias("n")).groupBy().sum("n").first()[0] == taken
    assert mix_table(nothing).count() == mix_documents(nothing).count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abc", max_size=3), st.integers(0, 1000), min_size=1, max_size=7))
def test_water_fill_reference_is_feasible(sizes):
    found = water_fill(sizes)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(found[s] <= 2 * n + 1e-6 for s, n in sizes.items())


def test_water_fill_plan(spark):
    from shardwright.llm.mixing import water_fill as plan

    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 1, None: 3}, {"a": 0}, {"a": 5, "b": 0, "z": 7, "y": 900}):
        totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in plan(totals, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(water_fill(sizes))


def test_water_fill_of_tied_sources(spark):
    from shardwright.llm.mixing import water_fill as plan

    totals = spark.createDataFrame([("a", 300), ("b", 100), ("c", 200), ("d", 300)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in plan(totals, (3, 1, 2), 1.5, 2.0).collect()}
    assert got == pytest.approx({"a": 450, "b": 150, "c": 300, "d": 450})
