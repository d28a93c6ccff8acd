"""Every query that SQL can express gives the same rows in both engines; the others run."""

from __future__ import annotations

import pytest
from helpers import assert_same

from shardwright.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


#: Queries without SQL, the table whose rows they deal, its key, and how many parts there may be.
DEALT = {
    "bin_kmeans": ("orders", "o_orderkey", "bin", 5),
    "feature_kmeans": ("embeddings", "vec_id", "partition", 5),
    "feature_tsne": ("embeddings", "vec_id", "partition", 5),
    "difficulty_regression": ("part", "p_partkey", "partition", 3),
    "difficulty_forest": ("embeddings", "vec_id", "partition", 3),
    "multilabel_stratified": ("labels", "doc_id", "partition", 5),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_deals_every_row_once(spark, sf_dir, name):
    source, key, part, most = DEALT[name]
    got = QUERIES[name](spark, sf_dir).toPandas()
    ids = sorted(r[key] for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key).collect())
    assert sorted(got[key]) == ids and 2 <= got[part].nunique() <= most
    if name == "difficulty_regression":
        sizes = got.groupby(part).size()
        assert sizes.max() - sizes.min() <= 1


def test_kmeans_bins_are_its_cells(spark, sf_dir):
    """Every price lies in the bin of the centre nearest to it, so bins follow each other without overlap."""
    got = QUERIES["bin_kmeans"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey").toPandas()
    spans = got.groupby("bin")["o_totalprice"].agg(["min", "max"]).sort_index()
    assert (spans["max"].to_numpy()[:-1] < spans["min"].to_numpy()[1:]).all()


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
