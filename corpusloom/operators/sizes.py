"""Joins whose strategy is chosen from a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key set of at most so many 64-bit keys (8 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def by_size(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """keys with a broadcast hint if it has at most limit rows. Counts them: stage keys first."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def only(df: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df whose column `on` is in keys (one 64-bit column of that name, staged)."""
    return df.join(by_size(keys, limit), on, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it has fewer partitions than there are cores, as one small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
