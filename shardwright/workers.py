"""What Python workers need: this package's code, and batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shardwright-")) / "shardwright_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"shardwright/{path.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the rows a Python worker gets at once, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
