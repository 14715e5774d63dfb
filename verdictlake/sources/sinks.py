"""Sinks: reports as CSV with a header, or as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, kind: str = "csv", files: int | None = 1) -> None:
    """Overwrite ``path``; nulls become empty fields. Reports are small; ``files=None`` keeps the partitions."""
    out = df.coalesce(files) if files else df
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
