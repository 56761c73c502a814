"""Scheduled ingest as a stream of ticks.

A file stream would miss edits in place and deletions, so the stream carries nothing but the time: each tick runs the
batch comparison with the manifest, which sees both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..lock import LockHeld, WriterLock
from ..operators.ingest import IngestReport, ingest
from ..operators.store import ChunkStore


def ingest_on_ticks(
    spark: SparkSession, root: str, store: ChunkStore, *, every: str = "15 minutes", checkpoint: str, report: Callable[[IngestReport | None], None] = lambda r: None, rebuild_every: int | None = None, **options
) -> StreamingQuery:
    """Run an ingest at every trigger. A tick that meets a live lock is skipped, and reports None. Each tick whose number
    divides by rebuild_every makes the table anew (672 ticks of 15 minutes are a week)."""

    def tick(_, number: int) -> None:
        anew = {"incremental": False} if rebuild_every and number and number % rebuild_every == 0 else {}
        try:
            with WriterLock(store.path):
                report(ingest(spark, root, store, **options | anew))
        except LockHeld:
            report(None)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
