"""Shared plumbing of the training-data operators: sessions, shared storage, table access."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.workers import ship_code, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new one on this machine, which only a local session may use."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured or tempfile.mkdtemp(prefix="shardwright-")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``docs`` bears, whatever its case."""
    tag = uuid.uuid4().hex[:8] if any(c.lower() in map(str.lower, names) for c in docs.columns) else ""
    return [f"{n}_{tag}" if tag else n for n in names]


def all_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` by name, whatever characters a name holds."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of small columns that one task may well hold.
ROWS_A_TASK = 50_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few partitions as ``rows`` rows at most need, so that small tables cost few tasks and files."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """True for rows whose crc32 of the key's text leaves ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def prepare_workers(spark: SparkSession) -> None:
    """Called by every operator that runs Python on the executors."""
    ship_code(spark)
    small_batches(spark)


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable) -> Callable:
    """A worker's function that gives its freed memory back to the system when a task ends.

    Workers live on between tasks and stages; without this each keeps its largest footprint.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run
