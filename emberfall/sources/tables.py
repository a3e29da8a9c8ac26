"""Saved tables: the fact and the counts are written once and reloaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Rows of one directory are written by at most this many tasks.
FILES_PER_DIRECTORY = 8


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite the Parquet table at ``path``.

    With ``partition_by`` rows are first dealt by these columns and a salt, so that a
    directory gets a few files, not one from every task, and a large one is not written by
    one task alone.
    """
    if partition_by:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(FILES_PER_DIRECTORY))
        df.repartition(*partition_by, salt).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Scan a saved table."""
    return spark.read.parquet(path)
