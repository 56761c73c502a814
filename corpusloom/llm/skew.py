"""Joins whose hot keys are dealt out over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import by_size
from ..scratch import staged


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], sizes: DataFrame, by: str, block: int) -> DataFrame:
    """many joined to one on keys. sizes is (keys, n), n the rows of a key in many: of a key with more than `block` rows
    these are dealt out by the column `by` to parts of about `block` rows, and the rows of one go to each part."""
    hot = staged(sizes.where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("parts_")), "hot-keys")
    if hot.isEmpty():
        return many.join(one, keys)
    hot = by_size(hot)
    parts = F.coalesce("parts_", F.lit(1))
    x = many.join(hot, keys, "left").withColumn("part_", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts_")
    y = one.join(hot, keys, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts_")
    return x.join(y, [*keys, "part_"]).drop("part_")
