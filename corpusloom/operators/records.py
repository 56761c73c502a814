"""One record per key from a table in which keys repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged


def record_rows(chunks: DataFrame, limit: int | None = None, keep: list[str] = ()) -> DataFrame:
    """chunks -> (id, heading, text, rid) and the columns in keep: one row per record, without moving any text where possible.

    All rows with one id are one record. A row with a heading wins over one whose heading is null or ''; among those
    the latest ingested_at wins (null is earliest); ties go to the greatest hash of the row. Rows without an id name no
    record and are left out. Null headings and texts come out as ''.

    rid is the id's 64-bit hash. Only ids and hashes are shuffled to find the rows that lose to another row of their
    id; they are taken out of the scan by a broadcast if they are few enough, else by a shuffled anti-join. A kept
    row may still come out more than once if the table repeats it as a whole.
    """
    from .sizes import BROADCAST_KEYS

    limit = BROADCAST_KEYS if limit is None else limit
    heading = F.coalesce(F.col("heading"), F.lit("")) if "heading" in chunks.columns else F.lit("")
    at = F.col("ingested_at") if "ingested_at" in chunks.columns else F.lit(None).cast("timestamp_ntz")
    rows = chunks.where(F.col("id").isNotNull()).select(
        "id",
        heading.alias("heading"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(at, F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"),
        *[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in keep],
    )
    rows = rows.withColumn("row_key", F.xxhash64("id", "heading", "text", *keep))
    slim = rows.select("id", "row_key", (F.col("heading") != "").alias("named"), "at")
    best = (
        slim.groupBy("id")
        .agg(
            F.max(F.struct("named", "at", "row_key")).getField("row_key").alias("best"),
            F.min("row_key").alias("lo"),
            F.max("row_key").alias("hi"),
        )
        .where("lo <> hi")
    )
    lost = slim.join(best, "id").where("row_key <> best").select("row_key").distinct()
    lost = staged(lost, "lost-rows")
    n = lost.limit(limit + 1).count()
    if n > limit:
        out = rows.join(lost, "row_key", "left_anti")
    elif n:
        out = rows.join(F.broadcast(lost), "row_key", "left_anti")
    else:
        out = rows
    return out.select("id", "heading", "text", F.xxhash64("id").alias("rid"), *keep)
