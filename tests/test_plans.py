"""Registry, configuration, sources, streaming and the experiment loop."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shardwright.operators.ensemble import hard_vote, mean_vote, soft_vote
from shardwright.plans.config import ExperimentConfigBuilder, coerce, parse_entity
from shardwright.plans.registry import AdaptiveSampler, SamplingStrategyFactory
from shardwright.plans.runner import Experiment, FileTracker
from shardwright.sources import synthetic
from shardwright.sources.sinks import save_report, write_partitions
from shardwright.sources.tables import Catalogue, Dataset, public_catalogue, read_table
from shardwright.streaming import hash_partitions


def test_factory(spark):
    factory = SamplingStrategyFactory()
    assert {"random", "balance", "temporal_split", "tsne_clustering"} <= set(factory.get_available_strategies())
    with pytest.raises(ValueError, match="known"):
        factory.create_strategy("other")
    got = factory.fit_transform("random", spark.range(10), {"key_cols": ["id"], "n_partitions": 2})
    assert got.count() == 10


def test_adaptive(spark):
    choose = AdaptiveSampler().auto_select_strategy
    assert type(choose(synthetic.time_series(spark, 2, 10), ["series_id", "timestamp"])).__name__ == "TemporalSplit"
    assert choose(synthetic.tabular(spark, 10), ["id"], "y").method == "kmeans"
    assert choose(synthetic.tabular(spark, 10), ["id"]).method == "dbscan"


def test_config():
    config = ExperimentConfigBuilder().from_text("datasets: a, b(key=id)\nsampling_strategies: random(n_partitions=4, random_state=-5)\ntime_budget_minutes: 3")
    assert [d.name for d in config.datasets] == ["a", "b"] and config.datasets[1].params == {"key": "id"}
    assert config.sampling_strategies[0].params == {"n_partitions": 4, "random_state": -5} and config.time_budget_minutes == 3
    assert coerce("-5") == -5 and coerce("0.5") == 0.5 and coerce("x") == "x"
    assert parse_entity("f(a=1, b=x)").params == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        parse_entity("f(a)")


def test_synthetic_tables(spark):
    assert synthetic.imbalanced(spark, 1000).agg(F.avg("target")).first()[0] < 0.2
    assert synthetic.two_normals(spark, 100).count() == synthetic.noisy_logistic(spark, 100).count() == 100
    assert synthetic.time_series(spark, 2, 30).count() == 60


def test_sources_and_sinks(spark, tmp_path):
    data = spark.createDataFrame([(1, "b"), (2, "a")], "id long, y string")
    data.write.option("header", True).csv(str(tmp_path / "t.csv"))
    catalogue = Catalogue([Dataset("t", "y", path=str(tmp_path / "t.csv"))])
    assert {r["id"]: r["y"] for r in catalogue.load(spark, "t").collect()} == {1: 1, 2: 0}
    with pytest.raises(ValueError):
        catalogue.find("other")
    with pytest.raises(ValueError):
        read_table(spark, "x.abc")
    write_partitions(data.withColumn("partition", F.lit("p")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert json.loads(save_report({"a": {"x": 1}}, str(tmp_path)).read_text()) == {"a": {"x": 1}}


def test_votes(spark):
    votes = spark.createDataFrame([(1, 2.0, [0.5, 0.5]), (1, 1.0, [0.2, 0.8]), (2, 3.0, [1.0, 0.0])], "id long, prediction double, probability array<double>")
    assert {r["id"]: r["prediction"] for r in hard_vote(votes, ["id"]).collect()} == {1: 1.0, 2: 3.0}
    assert {r["id"]: r["prediction"] for r in mean_vote(votes, ["id"]).collect()} == {1: 1.5, 2: 3.0}
    assert {r["id"]: r["prediction"] for r in soft_vote(votes, ["id"], 2).collect()} == {1: 1, 2: 0}


def test_experiment(spark, tmp_path):
    catalogue = Catalogue([Dataset("toy", "y", load=lambda s: synthetic.tabular(s, 300, 4))])
    config = ExperimentConfigBuilder().from_text("datasets: toy(key=id)\nsampling_strategies: random(n_partitions=2)\nautoml_models: logistic_regression")
    tracker = FileTracker(str(tmp_path / "runs.jsonl"))
    found = Experiment(spark, catalogue, config, str(tmp_path), tracker, baseline=True).run_full_benchmark()
    assert found["toy"]["accuracy"] > 0.8 and found["toy"]["n_models"] == 2 and found["toy"]["training_time"] > 0
    assert found["toy"]["baseline_accuracy"] > 0.8 and found["toy"]["baseline_n_models"] == 1
    assert tracker.runs[0]["metrics"]["accuracy"] == found["toy"]["accuracy"]
    assert FileTracker(str(tmp_path / "runs.jsonl")).history()[0]["metrics"] == tracker.runs[0]["metrics"]


def test_experiment_runs_every_pair_within_its_budget(spark):
    catalogue = Catalogue([Dataset("toy", "y", load=lambda s: synthetic.tabular(s, 200, 3))])
    text = "datasets: toy(key=id)\nsampling_strategies: random(n_partitions=2), stratified_kfold(n_partitions=2)\nautoml_models: logistic_regression, decision_tree\ntime_budget_minutes: "
    found = Experiment(spark, catalogue, ExperimentConfigBuilder().from_text(text + "10")).run_full_benchmark()["toy"]
    pairs = {f"{s}+{m}" for s in ("random", "stratified_kfold") for m in ("logistic_regression", "decision_tree")}
    assert {k for k in found if "+" in k} == pairs and found["accuracy"] == found["random+logistic_regression"]["accuracy"]
    found = Experiment(spark, catalogue, ExperimentConfigBuilder().from_text(text + "0")).run_full_benchmark()["toy"]
    assert {k for k in found if "+" in k} == {"random+logistic_regression"} and set(found["skipped"]) == pairs - {"random+logistic_regression"}


def test_public_catalogue(spark):
    known = public_catalogue(fetch=lambda s, number: s.createDataFrame([(number, "b"), (1, "a")], "x long, target string"))
    assert "adult" in known.of_task("classification") and "california" in known.of_task("regression")
    assert {r["x"]: r["target"] for r in known.load(spark, "adult").collect()} == {1590: 1, 1: 0}
    assert known.find("airlines").target == "DepDelay"
    with pytest.raises(ValueError, match="OpenML"):
        public_catalogue().load(spark, "adult")


def test_streams_take_what_was_frozen(spark, tmp_path):
    """Bins, hours and clusters of a stream are those of the table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from shardwright.operators.binning import quantile_edges
    from shardwright.streaming import fitted_clusters, frozen_bins, seasonal

    at = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp_ntz"))
    data = spark.range(60).select("id", (F.col("id") * 1.5).alias("v"), at.alias("ts"))
    data.write.parquet(str(tmp_path / "in"))
    edges = quantile_edges(data, "v", 4)
    assemble = VectorAssembler(inputCols=["v"], outputCol="features")
    model = KMeans(k=3, seed=1).fit(assemble.transform(data))
    for i, deal in enumerate((lambda d: frozen_bins(d, "v", edges), lambda d: seasonal(d, "ts"), lambda d: fitted_clusters(assemble.transform(d), model).drop("features"))):
        stream = deal(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(f"frozen{i}").start()
        query.processAllAvailable()
        query.stop()
        assert sorted(map(str, spark.sql(f"SELECT * FROM frozen{i}").collect())) == sorted(map(str, deal(data).collect()))


def test_stream_assignment_equals_batch(spark, tmp_path):
    data = spark.range(50)
    data.write.parquet(str(tmp_path / "in"))
    stream = hash_partitions(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), ["id"], 3)
    query = stream.writeStream.format("memory").queryName("dealt").start()
    query.processAllAvailable()
    query.stop()
    expected = {r["id"]: r["partition"] for r in hash_partitions(data, ["id"], 3).collect()}
    assert {r["id"]: r["partition"] for r in spark.sql("SELECT * FROM dealt").collect()} == expected
