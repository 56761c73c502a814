"""Problem 2: what changed between full snapshots.

A SnapshotIndex keeps, for each series, the key and value hash of every record of its last snapshot, in bucket folders
by series, and beside it the values. A series too large for one bucket is spread over several by key. Applying new
snapshots reads only the buckets of the series delivered, each in one task: a snapshot's rows probe the bucket by key,
what was added, removed or changed comes out, and the snapshot takes the bucket's place as the index that the next one
probes. The buckets touched are written anew, the others stay where they are, and one pointer moves. Old values are
read only for records that did change, from their buckets.

Defined results: records are keyed by heading, null counting as ''; a null text counts as ''; texts are compared after
line ends became '\\n'; several texts under one key of one snapshot are one value, in which order and repetition do not
count; a rel delivered more than once counts as its latest delivery (null delivered_at is earliest), as a whole; rows
without snapshot_date are no snapshots and rows without rel belong to no series: both take no part. The first snapshot
of a series adds nothing. An empty table gives no rows. Snapshots not later than the indexed one of their series cannot
be applied: they are left out and returned by `late`, for a rebuild.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import universal_newlines
from ..scratch import scratch_path, staged
from .commit import Pointer
from .sizes import BROADCAST_KEYS, by_size


def latest_deliveries(rows: DataFrame) -> DataFrame:
    """snapshot rows -> those of the latest delivery of each rel."""
    at = F.coalesce(F.col("delivered_at"), F.lit("0001-01-01").cast("timestamp_ntz"))
    last = rows.select("rel", at.alias("at")).groupBy("rel").agg(F.max("at").alias("last_at"))
    return rows.withColumn("last_at_", at).join(last, "rel").where("last_at_ = last_at").drop("last_at_", "last_at")


def series_of(rel: Column, date: Column) -> Column:
    """The rel without -<date>.md; the rel itself if it does not end so."""
    tail = F.concat(F.lit("-"), date, F.lit(".md"))
    return F.when(rel.endswith(tail), F.substring(rel, F.lit(1), F.length(rel) - F.length(tail))).otherwise(rel)


def snapshot_records(rows: DataFrame) -> DataFrame:
    """snapshot rows -> (series, snapshot_date, key, hash, text), one row per record of each snapshot."""
    rows = rows.select("rel", "snapshot_date", "heading", "text", "delivered_at").where(
        "snapshot_date is not null and rel is not null"
    )
    text = universal_newlines(F.coalesce(F.col("text"), F.lit("")))
    return (
        latest_deliveries(rows)
        .select(
            series_of(F.col("rel"), F.col("snapshot_date")).alias("series"),
            "snapshot_date",
            F.coalesce(F.col("heading"), F.lit("")).alias("key"),
            text.alias("text"),
        )
        .distinct()
        .groupBy("series", "snapshot_date", "key")
        .agg(F.array_sort(F.collect_list("text")).alias("texts"))
        .select(
            "series",
            "snapshot_date",
            "key",
            F.sha2(F.to_json("texts").cast("binary"), 256).alias("hash"),
            F.array_join("texts", "\n").alias("text"),
        )
    )


#: A bucket holds about so many records of a snapshot; a series with more is spread over several.
BUCKET_RECORDS = 200_000
_INDEX = "series string, snapshot_date string, key string, hash string, bucket int"
_VALUES = "series string, snapshot_date string, key string, text string, bucket int"
_SERIES = "series string, held string, spread int"
_WALKED = "kind string, series string, snapshot_date string, key string, change_kind string, hash string, old_date string, stored boolean, bucket int"


def _walk(batches):
    """One bucket after another, sorted by bucket, series and snapshot -> its changes and the index it is left with.

    Of a series the snapshot numbered 0 is the index as stored or, for a new series, its first snapshot. Each later one
    probes the index by key and takes its place. Held in memory is one snapshot of one series in one bucket.
    """
    at, index, fresh = None, {}, {}  # at: (bucket, series, n, date, the next date, stored) of the index
    out: list[tuple] = []

    def gone(date: str, keys) -> None:
        out.extend(("change", at[1], date, k, "removed", None, at[3], at[5], at[0]) for k in keys)

    def ended() -> None:
        """No snapshot of this series follows in this bucket."""
        if at[4] is not None:
            gone(at[4], index)
        else:
            out.extend(("index", at[1], at[3], k, None, h, None, None, at[0]) for k, h in index.items())

    def probe(new: tuple, keys: dict) -> None:
        """Compare a snapshot with the index, and swap."""
        nonlocal at, index
        same = at is not None and at[:2] == new[:2]
        if at is not None and not same:
            ended()
        if not same:
            # A bucket may hold none of the snapshots before: then the index is empty, but not new.
            at, index = (new[0], new[1], new[2] - 1, None, None, False), {}
        elif new[2] != at[2] + 1:
            gone(at[4], index)
            at, index = (at[0], at[1], new[2] - 1, None, None, False), {}
        if new[2] > 0:
            for k, h in keys.items():
                had = index.get(k)
                if had is None:
                    out.append(("change", new[1], new[3], k, "added", h, at[3], at[5], new[0]))
                elif had != h:
                    out.append(("change", new[1], new[3], k, "changed", h, at[3], at[5], new[0]))
            gone(new[3], [k for k in index if k not in keys])
        at, index = new, keys

    def flushed():
        cols = list(zip(*out))
        out.clear()
        kinds = [pa.string()] * 7 + [pa.bool_(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _WALKED.split(", ")])

    here = None
    for b in batches:
        names = ("bucket", "series", "n", "snapshot_date", "after", "stored", "key", "hash")
        for *now, key, h in zip(*(b.column(c).to_pylist() for c in names)):
            now = tuple(now)
            if now != here:
                if here is not None:
                    probe(here, fresh)
                here, fresh = now, {}
            fresh[key] = h
        if len(out) > 50_000:
            yield flushed()
    if here is not None:
        probe(here, fresh)
        ended()
    if out:
        yield flushed()


class SnapshotIndex:
    """The index in a folder that all executors share. None as the folder makes a scratch one."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, bucket_records: int = BUCKET_RECORDS):
        self.spark, self.buckets, self.bucket_records = spark, buckets, bucket_records
        self.path = path or scratch_path(spark, "snapshot-index")
        self.late: DataFrame | None = None
        self.changes: DataFrame | None = None
        self._pointer = Pointer(spark, self.path)
        self._state = self._pointer.read() or {"version": 0, "buckets": {}, "values": {}, "series": None, "n_buckets": None}

    def _read(self, kind: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        """The folders of some buckets, or of all; no other folder is looked at."""
        at = self._state[kind]
        paths = [f"{self.path}/{at[b]}" for b in (at if buckets is None else map(str, buckets)) if b in at]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def index(self, buckets: list[int] | None = None) -> DataFrame:
        """The last snapshot: (series, snapshot_date, key, hash, bucket)."""
        return self._read("buckets", _INDEX, buckets)

    def values(self, buckets: list[int] | None = None) -> DataFrame:
        """(series, snapshot_date, key, text, bucket) of the last snapshot; read only where an old value is asked for."""
        return self._read("values", _VALUES, buckets)

    def series(self) -> DataFrame:
        """(series, held, spread): the date of each series' last snapshot and the buckets it is spread over."""
        at = self._state["series"]
        return self.spark.read.schema(_SERIES).parquet(f"{self.path}/{at}") if at else self.spark.createDataFrame([], _SERIES)

    def _calendar(self, records: DataFrame) -> DataFrame:
        """(series, snapshot_date, records, held, spread) of the snapshots delivered, and those after the index numbered
        by n, with the date of the next in `after`. A new series begins with 0, a held one with 1."""
        days = records.groupBy("series", "snapshot_date").agg(F.count("*").alias("records")).join(self.series(), "series", "left")
        late = F.coalesce(F.col("snapshot_date") <= F.col("held"), F.lit(False)).alias("late")
        w = Window.partitionBy("series", "late")
        days = days.select("*", late).withColumn("after", F.lead("snapshot_date").over(w.orderBy("snapshot_date")))
        n = F.row_number().over(w.orderBy("snapshot_date")) - F.when(F.col("held").isNull(), 1).otherwise(0)
        wide = F.coalesce("spread", F.ceil(F.max("records").over(w) / self.bucket_records).cast("int")).alias("spread")
        return staged(days.select("series", "snapshot_date", "records", "held", "late", "after", n.alias("n"), wide), "snapshot-days")

    def _bucket(self, n_buckets: int, salt) -> Column:
        return F.pmod(F.xxhash64("series", salt.cast("int")), F.lit(n_buckets)).cast("int")

    def apply(self, records: DataFrame, *, with_values: bool = False, keep_values: bool = True, stored: bool = False) -> DataFrame:
        """Apply snapshots, give the changes (series, snapshot_date, key, change_kind), and swap the index.

        records: as from snapshot_records. with_values adds old_text and new_text (null where there is none).
        keep_values=False keeps hashes only; old texts cannot be given then. stored says that records are read from a
        stored table, and need not be staged.
        """
        columns = ["series", "snapshot_date", "key", "hash"] + ["text"] * (with_values or keep_values)
        records = records.select(*columns) if stored else staged(records.select(*columns), "snapshot")
        every = self._calendar(records)
        days = every.where("not late")
        last_of = F.when(F.col("after").isNull() & ~F.col("late"), F.col("records"))
        n_days, total = every.agg(F.count("*"), F.coalesce(F.sum(last_of), F.lit(0))).first()
        few = F.broadcast if n_days <= BROADCAST_KEYS else lambda df: df
        self.late = records.join(few(every.where("late").select("series", "snapshot_date")), ["series", "snapshot_date"], "left_semi")
        n_buckets = self._state["n_buckets"]
        if n_buckets is None:
            n_buckets = self.buckets or max(self.spark.sparkContext.defaultParallelism, -(-total // self.bucket_records))
        salts = F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt")
        spread = days.select("series", "spread").distinct().select("series", salts)
        touched = sorted(r[0] for r in spread.select(self._bucket(n_buckets, F.col("salt")).alias("b")).distinct().collect())  # n_buckets at most

        salt = F.pmod(F.xxhash64("key"), F.col("spread"))
        calendar = few(days.select("series", "snapshot_date", "n", "after", "spread"))
        fresh = records.join(calendar, ["series", "snapshot_date"]).withColumn("bucket", self._bucket(n_buckets, salt)).withColumn("stored", F.lit(False))
        first = few(days.where("n = 1 and held is not null").select("series", F.col("snapshot_date").alias("after")))
        old = self.index(touched).join(first, "series", "left").withColumn("n", F.lit(0)).withColumn("stored", F.lit(True))
        rows = ["bucket", "series", "n", "snapshot_date", "after", "stored", "key", "hash"]
        walked = old.select(*rows).unionByName(fresh.select(*rows)).repartitionById(n_buckets, "bucket")
        walked = walked.sortWithinPartitions("bucket", "series", "n").mapInArrow(_walk, _WALKED)
        folder = f"v{self._state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        walked.withColumn("folder", F.col("bucket")).write.option("compression", "lz4").partitionBy("kind", "folder").parquet(f"{self.path}/{folder}/keys")
        self.changes = self._changes(f"{folder}/keys/kind=change")
        out = self.changes if not with_values else self._with_values(self.changes, fresh)

        state = {**self._state, "version": self._state["version"] + 1, "n_buckets": n_buckets, "series": f"{folder}/series"}
        state["buckets"] = self._swapped("buckets", touched, f"{folder}/keys/kind=index/folder=")
        last = days.where("after is null").select("series", F.col("snapshot_date").alias("held"), "spread")
        self.series().join(last, "series", "left_anti").unionByName(last).write.parquet(f"{self.path}/{folder}/series")
        if keep_values:
            # A snapshot is full: of the series delivered no old value stays.
            kept = self.values(touched).join(few(last.select("series")), "series", "left_anti")
            kept = kept.unionByName(fresh.where("after is null").select("series", "snapshot_date", "key", "text", "bucket"))
            kept = kept.repartitionById(n_buckets, "bucket").withColumn("folder", F.col("bucket"))
            kept.write.option("compression", "lz4").partitionBy("folder").parquet(f"{self.path}/{folder}/values")
            state["values"] = self._swapped("values", touched, f"{folder}/values/folder=")
        self._pointer.swap(state)
        self._state = state
        return out.select("series", "snapshot_date", "key", "change_kind", *["old_text", "new_text"] * with_values)

    def _changes(self, at: str) -> DataFrame:
        ddl = _WALKED.replace("kind string, ", "", 1)
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{at}") if self._pointer.exists(at) else self.spark.createDataFrame([], ddl)

    def _swapped(self, kind: str, touched: list[int], to: str) -> dict:
        """Where each bucket is: those touched in the new folder, if they hold anything, the others where they were."""
        out = {b: p for b, p in self._state[kind].items() if int(b) not in set(touched)}
        return out | {str(b): f"{to}{b}" for b in touched if self._pointer.exists(f"{to}{b}")}

    def _with_values(self, changes: DataFrame, fresh: DataFrame) -> DataFrame:
        """changes with old_text and new_text: values of the index are read from the buckets with such changes alone."""
        asked = sorted(r[0] for r in changes.where("stored and change_kind <> 'added'").select("bucket").distinct().collect())  # n_buckets at most
        wanted = changes.where("change_kind <> 'added'").select("series", F.col("old_date").alias("snapshot_date"), "key")
        names = ["series", "snapshot_date", "key", "text"]
        old = fresh.select(*names).unionByName(self.values(asked).select(*names)).join(wanted, names[:3], "left_semi")
        old = old.select("series", F.col("snapshot_date").alias("old_date"), "key", F.col("text").alias("old_text"))
        new = fresh.select("series", "snapshot_date", "key", F.col("text").alias("new_text"))
        new = new.join(changes.where("change_kind <> 'removed'").select(*names[:3]), names[:3], "left_semi")
        dated = F.when(F.col("change_kind") != "added", F.col("old_date"))
        out = changes.withColumn("old_date", dated).join(old, ["series", "old_date", "key"], "left").join(new, names[:3], "left")
        return staged(out.select("series", "snapshot_date", "key", "change_kind", "old_text", "new_text"), "snapshot-values")


def snapshot_changes(rows: DataFrame, deliveries: int = 3, *, with_values: bool = False) -> DataFrame:
    """All changes in a table of snapshots: (series, snapshot_date, heading, change_kind), and with_values both texts.

    The dates are dealt out to `deliveries` consecutive groups, and each is applied to the index that the one before
    stored; inside a group each snapshot probes the index as the snapshot before left it.
    """
    spark = rows.sparkSession
    records = staged(snapshot_records(rows) if with_values else snapshot_records(rows).drop("text"), "snapshot-records")
    step = records.select("snapshot_date").distinct().withColumn("step", F.ntile(deliveries).over(Window.orderBy("snapshot_date")))
    step = staged(step, "snapshot-steps")
    index, out = SnapshotIndex(spark), None
    for i in range(1, deliveries + 1):
        delivered = records.join(by_size(step.where(F.col("step") == i)), "snapshot_date", "left_semi")
        changes = index.apply(delivered, keep_values=with_values, with_values=with_values, stored=True)
        out = changes if out is None else out.unionByName(changes)
    return out.withColumnRenamed("key", "heading")
