"""Writers."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from terrane.sources.tables import guard_columns


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet in the order of the keys: ranges by a sampled range partitioning, so that row groups can be skipped."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_blind(df: DataFrame, path: str, columns: list[str], forbidden: tuple[str, ...] = ("price",)) -> None:
    """Parquet of some columns, refused if a forbidden one is among them."""
    guard_columns(df.select(*columns), forbidden=forbidden).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for aggregates, whose size does not grow with the input."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_result(path: str, result: dict, **provenance) -> None:
    Path(path).write_text(json.dumps({**result, **provenance}, indent=1, sort_keys=True, default=str))


def write_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV report per named table below a folder; the paths."""
    paths = [f"{folder}/{name}.csv" for name in sorted(tables)]
    for name, path in zip(sorted(tables), paths):
        write_report(tables[name], path)
    return paths
