"""What must hold of the strategies whatever the data: covering, disjointness, quotas, edge cases."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardwright.functions.ordering import exact_quantiles, ntile_of, order_key, ranks, value_ranks
from shardwright.operators import binning
from shardwright.operators.features import mean_impute, zscore
from shardwright.operators.knn import at_places, nearest, squared_distances
from shardwright.operators.resample import Balancer
from shardwright.operators.strategies.balance import StratifiedBalanced
from shardwright.operators.strategies.clustering import FeatureClustering, TSNEClustering, _attraction, _repulsion, affinities, dbscan, tsne
from shardwright.operators.strategies.difficulty import DifficultySplit, UncertaintySplit, is_classification
from shardwright.operators.strategies.random import RandomSplit
from shardwright.operators.strategies.regression import RegressionBinning, RegressionStratified
from shardwright.operators.strategies.stratified import HierarchicalStratified, MultilabelStratified, StratifiedKFold, TrainTestSplit
from shardwright.operators.strategies.temporal import TemporalSplit
from shardwright.plans.registry import AdaptiveSampler


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(90).select("id", F.when(F.col("id") < 45, "a").when(F.col("id") < 85, "b").when(F.col("id") < 88, "c").otherwise("d").alias("y"), (F.col("id") * 1.5).alias("x"))


def parts(df, key="id"):
    found = {}
    for r in df.collect():
        found.setdefault(r["partition"], []).append(r[key])
    return found


def test_ranks_follow_the_whole_order(spark):
    data = spark.range(500).withColumn("_key", order_key(1, ["id"])).withColumn("g", F.col("id") % 3)
    got = ranks(data, ["g"], "_key", ["id"]).toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values(["_key", "id"])["rank"].tolist() == list(range(len(part)))
        assert set(part["total"]) == {len(part)}


def test_value_ranks(spark):
    data = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(300)], "id long, v double")
    got = value_ranks(data, "v", ["id"], cells=5).toPandas()
    expected = got.sort_values(["v", "id"], na_position="first")
    assert expected["rank"].tolist() == list(range(300))


@pytest.mark.parametrize("value", ["1.0", "id % 2", "CASE WHEN id % 10 > 0 THEN 3.0 ELSE id END", "CAST(NULL AS DOUBLE)"])
def test_value_ranks_of_ties_spread_over_tasks(spark, value):
    data = spark.range(2000).select((F.col("id") * 7 % 2000).alias("id")).withColumn("v", F.expr(value).cast("double"))
    got = value_ranks(data, "v", ["id"], cells=20)
    listed = got.toPandas().sort_values(["v", "id"], na_position="first")
    assert listed["rank"].tolist() == list(range(2000)) and set(listed["total"]) == {2000}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=900), np.zeros(300), [np.nan] * 0])
    data = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    expected = np.quantile(values, shares)
    for rows_a_cell in (10_000, 100, 7):
        assert np.allclose(exact_quantiles(data, "v", shares, rows_a_cell), expected)
    assert exact_quantiles(data.limit(0), "v", shares) == []


@pytest.mark.parametrize("n,k", [(0, 3), (2, 5), (10, 3), (9, 3), (11, 4)])
def test_ntile_is_array_split(spark, n, k):
    data = spark.range(n).select("id", ntile_of(F.col("id"), F.lit(n).cast("long"), k).alias("t"))
    expected = np.concatenate([[i] * len(p) for i, p in enumerate(np.array_split(np.arange(n), k))]) if n else []
    assert [r["t"] for r in data.orderBy("id").collect()] == list(expected)


def test_random_split_covers_and_repeats(rows):
    a, b = parts(RandomSplit(["id"], 4).assign(rows)), parts(RandomSplit(["id"], 4).assign(rows.repartition(7)))
    assert {k: sorted(v) for k, v in a.items()} == {k: sorted(v) for k, v in b.items()}
    assert sorted(sum(a.values(), [])) == list(range(90)) and {len(v) for v in a.values()} == {22, 23}
    assert parts(RandomSplit(["id"], 4, random_state=7).assign(rows)) != a


def test_random_split_of_fewer_rows_than_parts_and_none(spark):
    assert len(parts(RandomSplit(["id"], 5).assign(spark.range(2)))) == 2
    assert parts(RandomSplit(["id"], 5).assign(spark.range(0))) == {}
    with pytest.raises(ValueError):
        RandomSplit(["id"], 0)


def test_materialize_keeps_columns_and_null_keys(spark):
    data = spark.createDataFrame([(1, "a"), (None, "b")], "id long, v string")
    got = RandomSplit(["id"], 2).materialize(data)
    assert got.columns == ["partition", "id", "v"] and got.count() == 2


def test_materialize_refuses_to_lose_a_column(spark):
    data = spark.createDataFrame([(1, "mine")], "id long, Partition string")
    with pytest.raises(ValueError, match="already has"):
        RandomSplit(["id"], 2).materialize(data)


def test_kfold_is_disjoint_and_even(rows):
    got = StratifiedKFold(["id"], "y", 5).folds(rows).toPandas()
    assert sorted(got["id"]) == list(range(90))
    counts = got.groupby(["y", "fold"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()


def test_hierarchical_quota_and_rare_rows(rows):
    strategy = HierarchicalStratified(["id"], "y", 5, min_samples_per_class=1)
    got = strategy.folds(rows).toPandas()
    for _, fold in got.groupby("fold"):
        counts = Counter(fold["y"])
        assert counts["a"] + counts["b"] == 17 and counts["c"] == 3 and counts["d"] == 2
        assert fold["id"].is_unique


def test_hierarchical_all_rare_one_class_and_null_label(spark, rows):
    few = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, y string")
    assert HierarchicalStratified(["id"], "y", 3).folds(few).count() == 9
    one = rows.withColumn("y", F.lit("z"))
    assert Counter(HierarchicalStratified(["id"], "y", 5).folds(one).toPandas()["fold"]) == dict.fromkeys(range(5), 18)
    with pytest.raises(ValueError):
        HierarchicalStratified(["id"], "y", 1).folds(rows)


def test_train_test_share(rows):
    got = parts(TrainTestSplit(["id"], "y", 5).assign(rows))
    assert len(got["test"]) == 18 and len(got["train"]) == 72


def test_multilabel_folds_keep_label_shares(spark):
    data = spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(200)], "id long, p int, q int")
    got = MultilabelStratified(["id"], ["p", "q"], 5).materialize(data).toPandas()
    assert len(got) == 200 and got.groupby("partition").size().between(38, 42).all()
    assert got[got["q"] == 1].groupby("partition").size().tolist() == [4] * 5


def test_regression_strategies(spark):
    data = spark.range(200).select("id", (F.col("id") * 1.0).alias("v"))
    for strategy in ("quantile", "uniform", "kmeans"):
        got = RegressionStratified(["id"], "v", 4, strategy=strategy).folds(data).toPandas()
        assert set(got["fold"]) == set(range(4))
    assert RegressionBinning(["id"], "v", 4).folds(data).count() >= 200
    constant = data.withColumn("v", F.lit(1.0))
    assert RegressionBinning(["id"], "v", 4, bin_rule="scott").folds(constant).count() == 200
    with pytest.raises(ValueError):
        RegressionStratified(["id"], "v", strategy="other")


@pytest.mark.parametrize("n,k", [(58, 50), (10, 3), (3, 4), (100, 7)])
def test_temporal_sequential_is_linspace(spark, n, k):
    data = spark.range(n).select("id", F.lit(1).alias("series_id"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")).alias("timestamp"))
    got = parts(TemporalSplit(["id"], n_splits=k).assign(data))
    cuts = np.linspace(0, n, k + 1).astype(int)
    expected = {f"split_{i}": list(range(a, b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a}
    assert {p: sorted(v) for p, v in got.items()} == expected


def test_temporal_windows_seasons_and_errors(spark):
    data = spark.range(50).select("id", F.lit(1).alias("series_id"), F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")).alias("timestamp"))
    got = parts(TemporalSplit(["id"], n_splits=4, method="sliding_window", window_size=15).assign(data))
    assert {p: len(v) for p, v in got.items()} == {"split_0": 15, "split_1": 15, "split_2": 15}
    assert len(parts(TemporalSplit(["id"], method="seasonal").assign(data))) == 24
    with pytest.raises(ValueError):
        TemporalSplit(["id"], method="other")


def test_bins_match_pandas_and_numpy(spark):
    values = np.random.default_rng(0).normal(size=400)
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    edges = binning.quantile_edges(data, "v", 5)
    got = data.select("id", binning.bin_by_edges("v", edges).alias("b")).orderBy("id").toPandas()["b"]
    assert got.tolist() == pd.qcut(values, 5, labels=False).tolist()
    edges = binning.rule_edges(data, "v", "freedman_diaconis")
    got = data.select("id", binning.digitize("v", edges).alias("b")).orderBy("id").toPandas()["b"]
    assert got.tolist() == np.digitize(values, edges[1:-1]).tolist()


def test_bins_of_repeated_and_missing_values(spark):
    data = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,), (None,)], "v double")
    got = data.select(binning.bin_by_edges("v", binning.quantile_edges(data, "v", 4)).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 0, 0, 1, None]
    assert binning.rule_edges(data.limit(0), "v", "scott") == []
    stretched = spark.range(1000).select(F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") * 1.0).alias("v"))
    with pytest.raises(ValueError, match="bins"):
        binning.rule_edges(stretched, "v", "freedman_diaconis")


def test_merge_small_bins():
    assert binning.merge_small_bins({0: 10, 1: 1, 2: 10}, 5) == {0: 0, 1: 0, 2: 1}
    assert binning.merge_small_bins({0: 1, 1: 1, 2: 1}, 5) == {0: 0, 1: 0, 2: 0}
    assert binning.merge_small_bins({0: 9, 1: 2, 2: 4, 3: 9}, 5) == {0: 0, 1: 1, 2: 1, 3: 2}


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr("shardwright.operators.knn.BLOCK", 20)
    points = np.random.default_rng(1).normal(size=(70, 3))
    data = spark.createDataFrame([(i, i % 2, p.tolist()) for i, p in enumerate(points)], "id long, g long, x array<double>")
    got = nearest(data, ["g"], "id", "x", 4).toPandas()
    for g in (0, 1):
        own = np.arange(g, 70, 2)
        d2 = squared_distances(points[own], points[own])
        np.fill_diagonal(d2, np.inf)
        for row, i in enumerate(own):
            found = got[(got["g"] == g) & (got["id"] == i)].sort_values("place")["neighbour"].tolist()
            assert found == own[np.argsort(d2[row], kind="stable")[:4]].tolist()


@pytest.mark.parametrize("method", ["rus", "smote"])
def test_balanced_counts(spark, method):
    points = np.random.default_rng(2).normal(size=(60, 2))
    data = spark.createDataFrame([(i, int(i % 6 == 0), p.tolist()) for i, p in enumerate(points)], "id long, y int, features array<double>")
    got = StratifiedBalanced(["id"], "y", 2, balance_method=method).materialize(data).groupBy("partition", "y").count().toPandas()
    assert got.groupby("partition")["count"].nunique().eq(1).all()
    assert Counter(got["count"]) == ({5: 4} if method == "rus" else {25: 4})


def test_balance_refuses_unknown_methods():
    with pytest.raises(ValueError):
        StratifiedBalanced(["id"], "y", balance_method="other")


def _plain_enn(points, labels, k):
    """Rows that disagree with one of their nearest other rows, row by row."""
    lost = set()
    for i, p in enumerate(points):
        order = sorted((float(((p - q) ** 2).sum()), j) for j, q in enumerate(points) if j != i)[:k]
        if any(labels[j] != labels[i] for _, j in order):
            lost.add(i)
    return lost


@pytest.mark.parametrize("method", ["random_under_sample", "smote", "adasyn", "edited_neighbours", "tomek_links", "smote_enn", "smote_tomek"])
def test_balancing_with_null_labels_and_equal_points(spark, method):
    points = np.random.default_rng(4).normal(size=(40, 2)).round(1)
    points[30:] = points[0]
    labels = [None if i % 5 == 0 else i % 2 for i in range(40)]
    data = spark.createDataFrame([(i, "g", y, p.tolist()) for i, (y, p) in enumerate(zip(labels, points))], "id long, g string, y int, x array<double>")
    got = getattr(Balancer(["g"], "id", "y", "x"), method)(data).toPandas()
    assert got.columns.tolist() == ["g", "id", "y", "x", "synthetic"]
    real = got[~got["synthetic"]]
    assert real["id"].is_unique and set(real["id"]) <= set(range(40))
    counts = Counter("none" if y != y or y is None else int(y) for y in got["y"])
    if method == "random_under_sample":
        assert counts == {"none": 8, 0: 8, 1: 8}
    if method == "smote":
        assert counts == {"none": 16, 0: 16, 1: 16}
    if method == "edited_neighbours":
        assert set(range(40)) - set(real["id"]) == {i for i in _plain_enn(points, labels, 3) if labels[i] is not None}


def test_equal_synthetic_points_are_rows_of_their_own(spark):
    """All rows of the smaller class lie in one point: the made ones are each other's nearest and none may vanish as itself."""
    rows = [(i, "g", 0, [5.0 + i, 0.0]) for i in range(12)] + [(100 + i, "g", 1, [0.0, 0.0]) for i in range(3)]
    got = Balancer(["g"], "id", "y", "x").smote_enn(spark.createDataFrame(rows, "id long, g string, y int, x array<double>")).toPandas()
    assert Counter(got["y"]) == {0: 12, 1: 12} and got["synthetic"].sum() == 9


def test_neighbours_beyond_the_limit_are_refused(spark, monkeypatch):
    data = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id long, x array<double>")
    with pytest.raises(ValueError, match="neighbours"):
        nearest(data, [], "id", "x", 1001)
    monkeypatch.setattr("shardwright.operators.knn.MOST_ROWS", 10)
    with pytest.raises(ValueError, match="rows"):
        nearest(data, [], "id", "x", 2)


def test_neighbours_at_any_place_are_brute_force(spark, monkeypatch):
    """Copies tie by key, and every place down to the last is found, by one task or by many."""
    points = np.random.default_rng(5).normal(size=(60, 3)).round(1)
    points[40:] = points[:20]
    data = spark.createDataFrame([(i, i % 2, p.tolist()) for i, p in enumerate(points)], "id long, g long, x array<double>")
    wanted = data.select("g", "id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("place"))
    for pairs in (400_000_000, 100):
        monkeypatch.setattr("shardwright.operators.knn.PAIRS_A_TASK", pairs)
        got = at_places(data, ["g"], "id", "x", wanted).toPandas()
        assert len(got) == 60 * 29
        for i in range(60):
            others = [j for j in range(i % 2, 60, 2) if j != i]
            d2 = squared_distances(points[[i]], points[others])[0]
            found = got[got["id"] == i].sort_values("place")
            assert found["neighbour"].tolist() == [j for _, j in sorted(zip(d2, others))]
            assert found["d2"].tolist() == sorted(d2)


def test_nearest_among_copies_and_many_rows(spark, monkeypatch):
    """Enough rows that the bound on the k-th comes from strips; ties go to the smaller key also across blocks."""
    monkeypatch.setattr("shardwright.operators.knn.BLOCK", 250)
    points = np.random.default_rng(6).normal(size=(600, 2)).round(1) + 1000
    data = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>")
    d2 = squared_distances(points, points)
    np.fill_diagonal(d2, np.inf)
    for queries in (None, data.where("id % 7 = 0")):
        got = nearest(data, [], "id", "x", 3, queries).toPandas().sort_values(["id", "place"])
        ids = got["id"].unique()
        assert len(ids) == (600 if queries is None else 86)
        assert got["neighbour"].to_numpy().reshape(-1, 3).tolist() == np.argsort(d2[ids], axis=1, kind="stable")[:, :3].tolist()


def test_smote_of_a_class_beyond_the_listed_neighbours(spark):
    """The smallest class has more rows than neighbours are listed for a row."""
    points = np.random.default_rng(7).normal(size=(3300, 2))
    data = spark.createDataFrame([(i, int(i % 3 == 0), p.tolist()) for i, p in enumerate(points)], "id long, y int, x array<double>")
    got = Balancer([], "id", "y", "x").smote(data)
    assert {(r["y"], r["synthetic"]): r["count"] for r in got.groupBy("y", "synthetic").count().collect()} == {(0, False): 2200, (1, False): 1100, (1, True): 1100}


@pytest.mark.parametrize("method", ["smote_tomek", "smote_enn"])
def test_cleaning_after_smote_of_a_large_class(spark, method):
    """What stays is what stays of the filled rows by all pairs."""
    points = np.random.default_rng(8).normal(size=(3300, 2))
    data = spark.createDataFrame([(i, int(i % 3 == 0), p.tolist()) for i, p in enumerate(points)], "id long, y int, x array<double>")
    balancer = Balancer([], "id", "y", "x")
    filled = balancer.smote(data).toPandas()
    x, y = np.stack(filled["x"].to_numpy()), filled["y"].to_numpy()
    d2 = squared_distances(x, x)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1, kind="stable")[:, :3]
    if method == "smote_tomek":
        lost = (near[near[:, 0], 0] == np.arange(len(x))) & (y[near[:, 0]] != y)
    else:
        lost = (y[near] != y[:, None]).any(1)
    got = getattr(balancer, method)(data).toPandas()
    assert lost.any() and sorted(map(tuple, got["x"])) == sorted(map(tuple, x[~lost]))


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written for others to read."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("method", ["smote_tomek", "smote_enn"])
def test_cleaning_after_smote_moves_points_once(spark, method):
    """The filled rows are moved to where they are compared (and the smaller class to where it is filled up), not again to be joined."""
    points = np.random.default_rng(9).normal(size=(1500, 64))
    data = spark.createDataFrame([(i, int(i % 3 == 0), p.tolist()) for i, p in enumerate(points)], "id long, y int, x array<double>").localCheckpoint()
    before = _shuffled(spark)
    assert getattr(Balancer([], "id", "y", "x"), method)(data).collect()
    assert _shuffled(spark) - before < 1.25 * (2000 + 500) * 64 * 8


def test_smote_asks_nothing_of_the_largest_class(spark, monkeypatch):
    monkeypatch.setattr("shardwright.operators.knn.MOST_ROWS", 100)
    data = spark.createDataFrame([(i, int(i % 4 == 0), [float(i), i / 7]) for i in range(240)], "id long, y int, x array<double>")
    assert Balancer([], "id", "y", "x").smote(data).where("synthetic").count() == 120


def test_features(spark):
    data = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)], "id long, v double")
    assert [r["v"] for r in mean_impute(data, ["v"]).orderBy("id").collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r["v"] for r in zscore(data.where("id IN (1, 4)"), ["v"]).orderBy("id").collect()] == [-1.0, 1.0]


def _blobs(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.05, size=(30, 2)) for c in (0, 3, 6)])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(999, 40.0, -40.0)], "id long, a double, b double")


@pytest.mark.parametrize("method,options", [("kmeans", {"n_clusters": 3}), ("dbscan", {"eps": 0.3, "min_samples": 4})])
def test_clusters_find_blobs(spark, method, options):
    data = _blobs(spark) if method == "dbscan" else _blobs(spark).where("id < 999")
    got = FeatureClustering(["id"], method=method, **options).assign(data).toPandas()
    blob = got["id"] // 30
    assert got.groupby(blob)["partition"].nunique().eq(1).all() and len(got) == 90


def _plain_dbscan(points, eps, least):
    """Clusters by key of row, row by row over all pairs; None for noise."""
    d2 = squared_distances(points, points)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    root = np.arange(len(points))
    for i in np.flatnonzero(core):
        if root[i] == i:
            todo = [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if root[j] > i:
                        root[j] = i
                        todo.append(j)
    owner = [min(((d2[i, j], j) for j in np.flatnonzero(near[i] & core)), default=(0, None))[1] for i in range(len(points))]
    number = {r: n for n, r in enumerate(sorted({root[j] for j in owner if j is not None}))}
    return [None if j is None else number[root[j]] for j in owner]


@pytest.mark.parametrize("width,eps,least", [(1, 0.01, 4), (2, 0.1, 5), (2, 0.25, 9), (4, 0.5, 4)])
def test_dbscan_is_brute_force(spark, width, eps, least):
    """Dense and thin places, border rows, noise and copies; the grid of a lattice puts pairs at just eps."""
    rng = np.random.default_rng(width * 10 + least)
    points = np.concatenate([rng.normal(size=(300, width)), rng.normal(1, 0.05, size=(200, width)), np.round(rng.normal(size=(100, width)) * 4) / 4])
    points[::50] = points[7]
    names = [f"f{i}" for i in range(width)]
    data = spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(points)], ", ".join(["id long", *[f"{n} double" for n in names]]))
    got = {r["id"]: r["cluster"] for r in dbscan(data, "id", names, eps, least).collect()}
    assert [got[i] for i in range(600)] == _plain_dbscan(points, eps, least)


def test_dbscan_of_one_dense_place(spark):
    """Forty thousand rows near each other have 1.6 billion pairs, none of which is written out."""
    rows = spark.range(40_000).selectExpr("id", "id * 1e-6 AS a", "(id % 7) * 1e-3 AS b")
    assert [tuple(r) for r in dbscan(rows, "id", ["a", "b"]).groupBy("cluster").count().collect()] == [(0, 40_000)]


def test_arrays_are_features(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(c, 0.1, size=(30, 10)) for c in (0, 5)])
    rows = [(i, [None if i == 3 and j == 2 else float(v) for j, v in enumerate(p)]) for i, p in enumerate(points)]
    data = spark.createDataFrame(rows, "id long, e array<double>")
    for strategy in (FeatureClustering(["id"], 2), AdaptiveSampler().auto_select_strategy(data, ["id"]), TSNEClustering(["id"], 2, feature_cols=["e"])):
        strategy.n_partitions = 2
        got = strategy.assign(data).toPandas()
        assert len(got) == 60 and got.groupby(got["id"] // 30)["partition"].nunique().eq(1).all() and got["partition"].nunique() == 2
    wide = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(80)], "id long, e array<float>")
    assert FeatureClustering(["id"], 3).assign(wide).count() == 80
    with pytest.raises(ValueError, match="numeric"):
        FeatureClustering(["id"]).assign(spark.createDataFrame([(1, ["a"])], "id long, e array<string>"))


def test_tsne_and_its_limit(spark):
    assert tsne(np.random.default_rng(0).normal(size=(40, 4)), rounds=50).shape == (40, 2)
    data = _blobs(spark).where("id < 999")
    assert TSNEClustering(["id"], 3).assign(data).count() == 90
    with pytest.raises(ValueError):
        TSNEClustering(["id"], 3, max_rows=10).assign(data)
    with pytest.raises(ValueError):
        FeatureClustering(["id"], method="pca")


def test_tsne_forces_are_those_of_all_pairs():
    rng = np.random.default_rng(10)
    for wide in (0.01, 20.0):
        for width in (2, 3):
            y = rng.normal(size=(400, width)) * wide
            q = 1 / (1 + squared_distances(y, y))
            np.fill_diagonal(q, 0)
            plain = ((q * q).sum(1)[:, None] * y - (q * q) @ y) / q.sum()
            assert np.abs(_repulsion(y) - plain).max() < 0.01 * np.abs(plain).max()
    x = rng.normal(size=(400, 5))
    d2 = squared_distances(x, x)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1)[:, :30]
    share = affinities(np.take_along_axis(d2, near, 1), 10.0)
    assert np.allclose(np.exp(-(share * np.log(share)).sum(1)), 10.0, rtol=1e-3)
    p = np.zeros((400, 400))
    np.put_along_axis(p, near, share, 1)
    w = (p + p.T) / 800 / (1 + squared_distances(y, y))
    assert np.allclose(_attraction(y, near, share), w.sum(1)[:, None] * y - w @ y)


def test_tsne_of_a_large_table(spark):
    """More rows than pairs are counted for; every row is dealt, and two far blobs do not share a cluster."""
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(c, 0.1, size=(2600, 3)) for c in (0, 5)])
    data = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, e array<double>")
    got = TSNEClustering(["id"], 2, feature_cols=["e"]).assign(data).toPandas()
    assert sorted(got["id"]) == list(range(5200))
    assert max((got["partition"][got["id"] < 2600] == c).mean() for c in set(got["partition"])) > 0.9


def test_a_regressor_takes_few_distinct_numbers_for_numbers(spark):
    """Ten prices over 400 rows look like classes; the residuals of a line decide all the same."""
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=400), rng.integers(0, 10, 400) * 1.5
    data = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    got = DifficultySplit(["id"], "y", ["x"], 3, estimator=LinearRegression(solver="normal", regParam=0.0)).assign(data).toPandas().set_index("id")["partition"]
    fold = np.arange(400) // 80
    error = np.empty(400)
    for f in range(5):
        slope, base = np.polyfit(x[fold != f], y[fold != f], 1)
        error[fold == f] = np.abs(y - slope * x - base)[fold == f]
    for chunk, ids in enumerate(np.array_split(np.argsort(error), 3)):
        assert set(got[ids]) == {f"chunk_{chunk}"}


def test_difficulty_and_uncertainty(spark):
    data = spark.range(120).select("id", (F.col("id") % 2).cast("string").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("f"))
    hard = DifficultySplit(["id"], "y", ["f"], threshold=0.5).assign(data)
    assert hard.count() == 120 and set(parts(hard)) <= {"hard", "easy"}
    levels = parts(UncertaintySplit(["id"], "y", ["f"], 3).assign(data))
    assert {k: len(v) for k, v in levels.items()} == {f"uncertainty_level_{i}": 40 for i in range(3)}
    assert is_classification(data, "y") and not is_classification(data, "f")
    with pytest.raises(ValueError):
        UncertaintySplit(["id"], "f", ["id"]).scores(data)


def test_difficulty_without_probabilities(spark):
    """A model that gives none scores 0 or 1."""
    from pyspark.ml.classification import LinearSVC

    data = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("y"), F.when(F.col("id") == 7, 0.0).otherwise(F.col("id") % 2).alias("f"))
    scores = {r["id"]: r["score"] for r in DifficultySplit(["id"], "y", ["f"], estimator=LinearSVC(maxIter=20)).scores(data).collect()}
    assert scores.pop(7) == 1.0 and set(scores.values()) == {0.0}


def test_nearest_centroid(spark):
    from pyspark.ml.linalg import Vectors

    from shardwright.operators.centroid import NearestCentroid

    rows = [(0.0, Vectors.dense(0, 0)), (0.0, Vectors.dense(2, 0)), (2.0, Vectors.dense(5, 0))]
    rows = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    found = NearestCentroid().fit(rows).transform(rows).collect()
    assert [r["prediction"] for r in found] == [0.0, 0.0, 2.0]
    near, far = np.exp(-1), np.exp(-9)
    assert found[1]["probability"] == pytest.approx([near / (near + far), 0.0, far / (near + far)])


def test_long_series_are_cut_in_time(spark):
    """One series with many equal times and nulls: the cut into pieces changes nothing."""
    at = F.when(F.col("id") % 50 == 0, None).otherwise(F.timestamp_add("HOUR", (F.col("id") % 7).cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")))
    data = spark.range(300).select("id", F.lit(1).alias("series_id"), at.alias("timestamp"))
    got = TemporalSplit(["id"], n_splits=3).assign(data).toPandas()
    order = sorted(((r["timestamp"] is not None, r["timestamp"], r["id"]) if r["timestamp"] else (False, None, r["id"]) for r in data.collect()), key=lambda x: (x[0], x[1] or 0, x[2]) if x[0] else (x[0], 0, x[2]))
    expected = {key: f"split_{i // 100}" for i, (_, _, key) in enumerate(order)}
    assert dict(zip(got["id"], got["partition"])) == expected
