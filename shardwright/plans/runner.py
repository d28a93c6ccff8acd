"""Runs an experiment: load, split, partition, train a model per partition, vote, score, save."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.operators.ensemble import PartitionEnsemble
from shardwright.operators.features import numeric_columns
from shardwright.operators.metrics import classification_metrics, regression_metrics
from shardwright.operators.strategies.stratified import TrainTestSplit
from shardwright.plans.config import ExperimentConfig, Spec
from shardwright.plans.registry import SamplingStrategyFactory
from shardwright.sources.sinks import print_report, save_report
from shardwright.sources.tables import Catalogue


class ExperimentTracker:
    """Keeps runs and their numeric metrics; subclass it to send them elsewhere."""

    def __init__(self) -> None:
        self.runs: list[dict] = []

    @contextmanager
    def run(self, name: str, params: dict | None = None):
        record = {"name": name, "params": params or {}, "metrics": {}}
        self.runs.append(record)
        try:
            yield record
        finally:
            record["ended"] = True

    def log_metrics(self, record: dict, metrics: dict) -> None:
        record["metrics"] |= {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}

    @staticmethod
    def version_label(name: str, number: int) -> str:
        return f"{name}-v{number}"


class FileTracker(ExperimentTracker):
    """Also writes every run that has ended as a line of JSON to a file, which later runs go on with."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    @contextmanager
    def run(self, name: str, params: dict | None = None):
        began = time.time()
        with super().run(name, params) as record:
            yield record
        with self.path.open("a") as out:
            out.write(json.dumps(record | {"seconds": round(time.time() - began, 3)}, default=str) + "\n")

    def history(self) -> list[dict]:
        """All runs of the file, oldest first."""
        return [json.loads(line) for line in self.path.read_text().splitlines()] if self.path.exists() else []


def _estimators(task: str) -> dict[str, Callable]:
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    if task == "classification":
        return {"random_forest": c.RandomForestClassifier, "logistic_regression": c.LogisticRegression, "decision_tree": c.DecisionTreeClassifier}
    return {"random_forest": r.RandomForestRegressor, "linear_regression": r.LinearRegression, "decision_tree": r.DecisionTreeRegressor}


class Experiment:
    """The whole loop over the datasets of a configuration.

    Every strategy is run with every model. The metrics of a dataset lie under
    ``strategy+model``; those of the first pair also stand for the dataset itself. Once the time
    budget is spent no further pair is begun (the first pair of a dataset always is), and
    ``skipped`` names the rest. With ``baseline`` the model is also trained on all training rows,
    and its metrics are reported beside those of the ensemble.
    """

    def __init__(self, spark: SparkSession, catalogue: Catalogue, config: ExperimentConfig, out_dir: str | None = None, tracker: ExperimentTracker | None = None, baseline: bool = False) -> None:
        self.baseline, self.until = baseline, float("inf")
        self.spark, self.catalogue, self.config, self.out_dir = spark, catalogue, config, out_dir
        self.tracker = tracker or ExperimentTracker()

    def run_full_benchmark(self) -> dict:
        results = {}
        self.until = time.time() + 60 * self.config.time_budget_minutes
        for spec in self.config.datasets:
            with self.tracker.run(spec.name, {"time_budget_minutes": self.config.time_budget_minutes}) as record:
                results[spec.name] = self.run_dataset(spec)
                self.tracker.log_metrics(record, results[spec.name])
        if self.out_dir:
            save_report(results, self.out_dir)
        print_report(results)
        return results

    def run_dataset(self, spec: Spec) -> dict:
        dataset = self.catalogue.find(spec.name)
        data = self.catalogue.load(self.spark, spec.name).where(F.col(dataset.target).isNotNull())
        key = spec.params.get("key")
        if key is None:
            raise ValueError(f"dataset {spec.name!r} needs key=<the column that identifies a row>")
        parts = TrainTestSplit([key], dataset.target).materialize(data)
        train = parts.where("partition = 'train'").drop("partition")
        test = parts.where("partition = 'test'").drop("partition")
        results: dict = {}
        skipped: list[str] = []
        for strategy in self.config.sampling_strategies:
            for model in self.config.automl_models:
                name = f"{strategy.name}+{model.name}"
                if results and time.time() > self.until:
                    skipped.append(name)
                    continue
                chosen = SamplingStrategyFactory().fit_transform(strategy.name, train, self._options(strategy, key, dataset.target))
                found = self._ensemble(dataset.task, dataset.target, key, chosen, test, model)
                if self.baseline:
                    whole = self._ensemble(dataset.task, dataset.target, key, train.withColumn("partition", F.lit("all")), test, model)
                    found |= {f"baseline_{k}": v for k, v in whole.items()}
                results = results or dict(found)
                results[name] = found
        return results | ({"skipped": skipped} if skipped else {})

    @staticmethod
    def _options(strategy: Spec, key: str, target: str) -> dict:
        options = {"key_cols": [key], **strategy.params}
        if strategy.name in ("stratified", "advanced_stratified", "hierarchical_stratified", "balance", "difficulty", "uncertainty", "stratified_kfold"):
            options.setdefault("label_col", target)
        if strategy.name in ("regression_stratified", "regression_binning"):
            options.setdefault("target_col", target)
        return options

    def _ensemble(self, task: str, target: str, key: str, partitioned: DataFrame, test: DataFrame, model: Spec) -> dict:
        from pyspark.ml.feature import Imputer, VectorAssembler

        began = time.time()
        columns = numeric_columns(test, [key, target])
        imputer = Imputer(inputCols=columns, outputCols=columns)
        as_double = lambda d: d.withColumns({c: F.col(c).cast("double") for c in columns}).withColumn("label", F.col(target).cast("double"))
        filled = imputer.fit(as_double(partitioned))
        assemble = VectorAssembler(inputCols=columns, outputCol="features")
        ready = lambda d: assemble.transform(filled.transform(as_double(d)))
        known = _estimators(task)
        if model.name not in known:
            raise ValueError(f"unknown model {model.name!r}; known: {', '.join(known)}")
        ensemble = PartitionEnsemble(lambda: known[model.name](**model.params), task).fit(ready(partitioned))
        votes = ensemble.predict(ready(test), [key])
        judged = votes.join(test.select(key, F.col(target).cast("double").alias("_y")), key)
        measure = classification_metrics if task == "classification" else regression_metrics
        found = measure(judged, "_y", "prediction").first().asDict()
        return found | {"training_time": time.time() - began, "n_models": len(ensemble.models)}
