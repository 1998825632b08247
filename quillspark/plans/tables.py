"""Readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: source rows of a task where rows are made larger
ROWS_A_TASK = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    """Tasks that rows need, which are counted, so that a task's share stays the same however many there are."""
    return max(1, -(-df.count() // ROWS_A_TASK))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into as many tasks as they need.

    What the rows become (pages, blocks, slugs) is much larger than their file, by whose size Spark makes its tasks: a
    small file would be one task.
    """
    return df.repartition(tasks(df), key)
