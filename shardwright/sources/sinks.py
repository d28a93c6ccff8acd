"""Results to files: partitioned tables, JSON reports, printed tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame


def write_partitions(rows: DataFrame, path: str) -> None:
    """One folder per partition."""
    rows.write.mode("overwrite").partitionBy("partition").parquet(path)


def _plain(value):
    """Numbers of other libraries as Python's."""
    return value.item() if hasattr(value, "item") else str(value)


def save_report(results: dict, folder: str, name: str = "results") -> Path:
    """A JSON file with the time in its name."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    path = target / f"{name}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}.json"
    path.write_text(json.dumps(results, indent=2, default=_plain))
    return path


def print_report(results: dict) -> list[str]:
    """The numeric metrics of each dataset, printed and returned as lines."""
    lines = []
    for name, metrics in results.items():
        numbers = {k: v for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        lines.append(f"{name}: " + ", ".join(f"{k}={v:.4f}" for k, v in sorted(numbers.items())))
    print("\n".join(lines))
    return lines
