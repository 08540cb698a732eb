"""Writing of results: ordered CSV, and tables with counters taken on the way."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, functions as F


def write_ordered_csv(df: DataFrame, order: str, path: str) -> None:
    """CSV files with a header, in the order of ``order`` across the files (a range partition, no single task)."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("header", True).csv(path)


def write_counted(df: DataFrame, path: str, **counters: Column) -> dict[str, int]:
    """Writes Parquet (zstd) and gives the number of rows for which each condition held, from the same pass."""
    watched = Observation()
    counts = [F.count_if(c).alias(n) for n, c in counters.items()]
    df.observe(watched, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return dict(watched.get)


def manifest(name: str, counts: dict[str, int], **about: str) -> str:
    """A table's manifest as JSON text with sorted keys."""
    return json.dumps({"table": name, "counts": counts, **about}, sort_keys=True)
