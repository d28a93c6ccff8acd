"""A corpus pipeline of five training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; between stages the rows are
written as Parquet and read again, so each stage starts from a table and a lost executor costs
no more than its own tasks.

Every stage takes null texts as empty, keeps rows that repeat apart unless it removes copies,
gives an empty table for an empty one, and leaves further columns of any name as they are (the
last stage gives its own columns).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shardwright.llm import exact_dedup, hf_backend, lsh_forest, mixing, toxicity
from shardwright.llm.common import held_out, shared_folder, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on the labels not held out, rejects; an empty text is scored too."""
    labels = table(spark, sf_dir, "labels").where(~held_out(5, 0))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null doc_id sorts below all."""
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays; a null doc_id comes last."""
    return lsh_forest.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word are never taken, null sources are one source."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return hf_backend.encode_documents(docs, hf_backend.load(hf_backend.DEFAULT_MODEL))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("ngram_join", remove_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learned models, MinHash and seeded sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written to the shared folder and read again.

    A stage's checkpoints go with it, and its table once its successor is written.
    """
    shared = shared_folder(spark)
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        spark.sparkContext.setCheckpointDir(f"{folder}/{name}-checkpoints")
        try:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        finally:
            spark.sparkContext.setCheckpointDir(shared)
            _delete(spark, f"{folder}/{name}-checkpoints")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # its successor is written, so nothing reads it any more
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs
