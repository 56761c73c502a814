"""De-duplication of consecutive dated snapshots, without loops.

In a series of dated files, a chunk that the file before holds too (same heading and text, as often) is not kept; it
adds its date to the chunk that began the run. Numbering equal chunks of a file, and then each of these down the dates,
makes every run an island: date ordinal minus position is the same along it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SERIES = 3
MOST_DATES = 60


def chunk_key(heading: Column, text: Column) -> Column:
    """16 hex digits that identify a chunk's heading and text."""
    zero = F.lit(bytearray(b"\x00"))
    parts = F.concat(F.coalesce(heading, F.lit("")).cast("binary"), zero, text.cast("binary"))
    return F.substring(F.sha2(parts, 256), 1, 16)


def parse_series(rel: Column) -> tuple[Column, Column]:
    """(series, date) of a rel whose name ends in -YYYY-MM-DD before the extension; nulls for others."""
    folder = F.regexp_extract(rel, r"(?s)^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(rel, r"(?s)^(?:.*/)?([^/]*)$", 1)
    stem = F.when(name.contains("."), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)
    pattern = r"^(.+)-(\d{4}-\d{2}-\d{2})$"  # fixed value: what makes a name dated
    dated = stem.rlike(pattern)
    return (
        F.when(dated, F.concat(folder, F.regexp_extract(stem, pattern, 1))),
        F.when(dated, F.regexp_extract(stem, pattern, 2)),
    )


def series_files(rels: DataFrame, min_files: int = MIN_SERIES) -> DataFrame:
    """(rel) -> (rel, series, snapshot_date, n) for series of at least min_files; n counts in order of date and rel.

    Dates are text: no calendar is asked.
    """
    series, date = parse_series(F.col("rel"))
    dated = rels.select("rel").distinct().select("rel", series.alias("series"), date.alias("snapshot_date")).where("series is not null")
    w = Window.partitionBy("series")
    return (
        dated.withColumn("files", F.count("*").over(w))
        .where(F.col("files") >= min_files)
        .withColumn("n", F.row_number().over(w.orderBy("snapshot_date", "rel")))
        .drop("files")
    )


def snapshot_plan(series: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files of series, as from series_files, and their chunks (rel, chunk_index, key) -> what is kept.

    (rel, chunk_index, owner_rel, owner_index, is_kept, snapshot_date, repeat_dates); repeat_dates is null where a chunk
    is not kept. A file without chunks breaks the runs of its series.
    """
    c = chunks.select("rel", "chunk_index", "key").join(series, "rel")
    c = c.withColumn("j", F.row_number().over(Window.partitionBy("series", "n", "key").orderBy("chunk_index")))
    down = Window.partitionBy("series", "key", "j").orderBy("n")
    c = c.withColumn("island", F.col("n") - F.row_number().over(down))
    run = Window.partitionBy("series", "key", "j", "island").orderBy("n")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumn("owner", F.first(F.struct("rel", "chunk_index", "n")).over(run))
    c = c.withColumn("dates", F.array_sort(F.collect_list(F.struct("n", "snapshot_date")).over(whole)))
    kept = F.col("owner.n") == F.col("n")
    later = F.transform(F.slice("dates", 2, F.greatest(F.size("dates") - 1, F.lit(0))), lambda x: x["snapshot_date"])
    return c.select(
        "rel",
        "chunk_index",
        F.col("owner.rel").alias("owner_rel"),
        F.col("owner.chunk_index").alias("owner_index"),
        kept.alias("is_kept"),
        "snapshot_date",
        F.when(kept, later).alias("repeat_dates"),
    )


def shown_dates(dates: Column) -> Column:
    """Repeat dates for a citation: a list, or first..last and their number above MOST_DATES; '' for none."""
    n = F.size(dates)
    span = F.concat(F.element_at(dates, 1), F.lit(".."), F.element_at(dates, -1), F.lit(" ("), n.cast("string"), F.lit(" snapshots)"))
    return F.when(dates.isNull() | (n <= 0), "").when(n <= MOST_DATES, F.array_join(dates, ",")).otherwise(span)


def span_signatures(plan: DataFrame) -> DataFrame:
    """(rel, spanh) of the files that have a chunk with repeats: 16 hex digits of which chunks repeat on which dates."""
    part = F.concat(F.col("chunk_index").cast("string"), F.lit(":"), F.array_join("repeat_dates", ","))
    parts = plan.where(F.size("repeat_dates") > 0).select("rel", F.struct("chunk_index", part.alias("s")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "|")
    return parts.groupBy("rel").agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("spanh"))
