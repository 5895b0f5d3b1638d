"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Session setting: tasks to deal small tables out to; unset, the scan decides.
SPREAD = "spanveil.spread"


def spread(spark: SparkSession) -> int | None:
    value = spark.conf.get(SPREAD, None)
    return int(value) if value else None


def read_table(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """A parquet table. ``spread`` deals its rows out to so many tasks, in turn.

    Text work is bound by the CPU, and a small file often has a single row
    group, which one task has to read alone. Tables of many row groups are best
    left in the partitions of the scan.
    """
    table = spark.read.parquet(path)
    return table if spread is None else table.repartition(spread)
