"""Table readers, the catalogue of named tables, and label encoding on load."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from shardwright.operators.features import label_encode


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its file suffix: Parquet, ORC, JSON or (with a header) CSV. Without ``schema`` CSV types are inferred."""
    kind = path.rstrip("/*").rpartition(".")[2].lower()
    if kind == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    reader = spark.read.schema(schema) if schema else spark.read
    formats = {"parquet": reader.parquet, "orc": reader.orc, "json": reader.json}
    if kind not in formats:
        raise ValueError(f"cannot read {path!r}; known: csv, parquet, orc, json")
    return formats[kind](path)


@dataclass
class Dataset:
    """A named table: a path, or a function that loads it (for stores that Spark has no reader for)."""

    name: str
    target: str
    task: str = "classification"
    path: str | None = None
    load: Callable[[SparkSession], DataFrame] | None = None


@dataclass
class Catalogue:
    """Named datasets; a name is looked up among custom, then classification, then regression sets."""

    datasets: list[Dataset] = field(default_factory=list)
    custom: list[Dataset] = field(default_factory=list)

    def register(self, dataset: Dataset, custom: bool = False) -> None:
        (self.custom if custom else self.datasets).append(dataset)

    def of_task(self, task: str) -> list[str]:
        return [d.name for d in self.datasets if d.task == task]

    def find(self, name: str) -> Dataset:
        ordered = [*self.custom, *sorted(self.datasets, key=lambda d: d.task != "classification")]
        for dataset in ordered:
            if dataset.name == name:
                return dataset
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted({d.name for d in ordered}))}")

    def load(self, spark: SparkSession, name: str, encode: bool = True) -> DataFrame:
        """The table; a string target of a classification set is encoded to 0..K-1 by sorted label."""
        dataset = self.find(name)
        data = dataset.load(spark) if dataset.load else read_table(spark, dataset.path)
        if encode and dataset.task == "classification" and dict(data.dtypes)[dataset.target] == "string":
            coded = label_encode(data, dataset.target, "_code")
            data = coded.drop(dataset.target).withColumnRenamed("_code", dataset.target)
        return data


# Names, numbers at OpenML, and files of the public benchmark sets.
OPENML_CLASSIFICATION = {"electricity": 151, "covertype": 1596, "adult": 1590, "numerai28.6": 23517, "bank-marketing": 1461}
OPENML_REGRESSION = {"black friday": 531, "diabetes": 847, "california": 43905, "house_prices": 42705, "medical_charges": 42728}
FILES = {
    "covtype-normalized": ("classification", "class", "covtype-normalized.csv"),
    "kddcup": ("classification", "label", "kddcup.csv"),
    "airlines": ("regression", "DepDelay", "airlines_train_regression_10M.csv"),
    "sf-police-incidents": ("classification", "ViolentCrime", "sf-police-incidents.csv"),
}


def public_catalogue(folder: str = "./dataset", fetch: Callable[[SparkSession, int], DataFrame] | None = None) -> Catalogue:
    """The public benchmark sets by name: files of ``folder``, and OpenML sets by way of ``fetch``.

    ``fetch`` takes the session and a set's number at OpenML and gives a table whose target is
    named ``target``; without it these sets can be found but not loaded.
    """

    def loader(name: str, number: int) -> Callable[[SparkSession], DataFrame]:
        def load(spark: SparkSession) -> DataFrame:
            if fetch is None:
                raise ValueError(f"{name!r} lies at OpenML (number {number}); give a function that fetches it")
            return fetch(spark, number)

        return load

    found = Catalogue()
    for task, sets in (("classification", OPENML_CLASSIFICATION), ("regression", OPENML_REGRESSION)):
        for name, number in sets.items():
            found.register(Dataset(name, "target", task, load=loader(name, number)))
    for name, (task, target, file) in FILES.items():
        found.register(Dataset(name, target, task, path=f"{folder}/{file}"), custom=True)
    return found
