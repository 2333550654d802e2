"""Sinks (A6-A9): tables, splits, labelled rows and metric frames written by Spark writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Overwrite ``path``; ``partition_by`` lets later per-split / per-cluster reads prune."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A6 as CSV with a header (nulls as empty fields, quotes escaped by doubling)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A (small) metric frame as JSON or CSV."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.option("header", True).csv(path))
