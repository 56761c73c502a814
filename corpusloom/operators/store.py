"""The chunk table: versioned parquet in buckets by id, changed by whole commits.

An id's bucket is that of its source and of the stretch of SPAN chunks it lies in, so a long source is spread over many.
How many buckets there are follows from the size of the first commit.

A commit rewrites only the buckets it touches, into a folder of its own, and then moves the pointer to the new set of
folders, together with the manifest's. A reader, or a run that dies half-way, never sees a mixture.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch_path
from .commit import Pointer
from .embed import Embedder

#: A bucket gets about so many chunks of the first commit, and a file of a bucket at most so many.
BUCKET_CHUNKS, FILE_CHUNKS, SPAN = 20_000, 200_000, 4096
COLUMNS = (
    "id string, source string, heading string, chunk_index int, text string, embedding array<float>, "
    "snapshot_date string, repeat_count int, repeat_dates string"
)
METADATA = ["source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates"]
MANIFEST = "rel string, sha256 string, chunks int, kept array<int>, spanh string"


class DimensionMismatchError(ValueError):
    """The table was built with vectors of another length."""


class ChunkStore:
    """A collection of chunks. path=None gives one that lives in scratch storage and keeps no manifest."""

    def __init__(self, spark: SparkSession, path: str | None, collection: str, embedder: Embedder, buckets: int | None = None):
        self.spark, self.collection, self.embedder, self.buckets = spark, collection, embedder, buckets
        self.persistent = path is not None
        self.path = path or scratch_path(spark, "store")
        self._pointer = Pointer(spark, f"{self.path}/{collection}")
        state = self._state()
        if state["version"] and state["embed_dim"] != embedder.dim:
            raise DimensionMismatchError(
                f"collection {collection!r} at {self.path} has vectors of {state['embed_dim']} numbers, "
                f"embedder {embedder.name!r} makes {embedder.dim}: use another collection or path"
            )

    def _state(self) -> dict:
        empty = {"version": 0, "embed_dim": self.embedder.dim, "buckets": {}, "manifest": None, "identity": None, "n_buckets": self.buckets}
        state = self._pointer.read() or empty
        self.buckets = state["n_buckets"]
        return state

    def table(self) -> DataFrame:
        paths = [f"{self._pointer.path}/{p}" for p in self._state()["buckets"].values()]
        if not paths:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(*paths)

    def manifest(self) -> tuple[DataFrame, dict | None]:
        """The manifest that was committed with the table, and the run identity it was made under."""
        state = self._state()
        if not state["manifest"]:
            return self.spark.createDataFrame([], MANIFEST), state["identity"]
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self._pointer.path}/{state['manifest']}")
        # A malformed row is dropped on its own; the file it names is then done again.
        return rows.where("rel is not null and sha256 is not null and chunks >= 0"), state["identity"]

    def _bucket(self):
        source = F.expr("substring(id, 1, length(id) - length(substring_index(id, '::', -1)) - 2)")
        stretch = F.floor(F.expr("try_cast(substring_index(id, '::', -1) as bigint)") / SPAN)
        return F.pmod(F.xxhash64(source, F.coalesce(stretch, F.lit(0))), F.lit(self.buckets)).cast("int").alias("bucket")

    def commit(
        self,
        *,
        upsert: DataFrame | None = None,
        delete: DataFrame | None = None,
        metadata: DataFrame | None = None,
        manifest: DataFrame | None = None,
        identity: dict | None = None,
        replace: bool = False,
        rows: int | None = None,
        ids: DataFrame | None = None,
    ) -> None:
        """Apply rows to insert or replace by id, ids to delete (id), and metadata to rewrite (id and METADATA), at once.

        A row that is upserted is not deleted; metadata of unknown ids is ignored. Ids are <source>::<chunk_index>, so
        an id's bucket follows from it. replace drops all that is there first. Repeated ids keep one row of them.
        rows is how many are upserted and ids their ids, if these are known beforehand: else they are taken from upsert,
        which is then computed again for them.
        """
        state = self._state()
        if upsert is not None and ids is None:
            ids = upsert.select("id")
        if self.buckets is None:
            rows = ids.count() if rows is None and upsert is not None else rows or 0
            self.buckets = max(self.spark.sparkContext.defaultParallelism, -(-rows // BUCKET_CHUNKS))
        bucket = self._bucket()
        changes = [d.select("id", bucket).distinct() for d in (ids if upsert is not None else None, delete, metadata) if d is not None]
        touched: set[int] = set()
        if replace:
            touched = set(range(self.buckets))
        elif changes:
            all_ids = changes[0]
            for d in changes[1:]:
                all_ids = all_ids.unionByName(d)
            touched = {r[0] for r in all_ids.select("bucket").distinct().collect()}  # at most `buckets` numbers
        folders = dict(state["buckets"])
        version = state["version"] + 1
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        if touched:
            held = [f"{self._pointer.path}/{folders[str(b)]}" for b in sorted(touched) if str(b) in folders]
            old = self.spark.read.schema(COLUMNS).parquet(*held) if held and not replace else self.spark.createDataFrame([], COLUMNS)
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            if upsert is not None:
                old = old.join(ids.select("id").distinct(), "id", "left_anti")
            if delete is not None:
                old = old.join(delete.select("id").distinct(), "id", "left_anti")
            if metadata is not None:
                new = metadata.dropDuplicates(["id"]).select("id", F.struct(*METADATA).alias("m"))
                keep = [F.when(F.col("m").isNotNull(), F.col("m")[c]).otherwise(F.col(c)).alias(c) if c in METADATA else F.col(c) for c in names]
                old = old.join(new, "id", "left").select(*keep)
            if upsert is not None:
                old = old.select(*names).unionByName(upsert.dropDuplicates(["id"]).select(*names))
            out = old.select(*names, self._bucket()).repartitionById(self.buckets, "bucket").sortWithinPartitions("source", "chunk_index")
            out.write.option("maxRecordsPerFile", FILE_CHUNKS).partitionBy("bucket").parquet(f"{self._pointer.path}/{folder}/chunks")
            for b in touched:
                folders.pop(str(b), None)
                if self._pointer.exists(f"{folder}/chunks/bucket={b}"):
                    folders[str(b)] = f"{folder}/chunks/bucket={b}"
        at = state["manifest"]
        if manifest is not None:
            at = f"{folder}/manifest"
            manifest.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{self._pointer.path}/{at}")
        self._pointer.swap(
            {
                "version": version,
                "embed_dim": self.embedder.dim,
                "buckets": folders,
                "manifest": at,
                "identity": identity if identity is not None else state["identity"],
                "n_buckets": self.buckets,
            }
        )

    # The store's single operations, each a commit of its own.

    def add(self, chunks: DataFrame) -> None:
        """Insert or replace chunks (id, source, heading, chunk_index, text and optional snapshot columns), embedded here."""
        have = set(chunks.columns)
        full = chunks.select(
            *[
                F.col(c) if c in have else F.lit(None).cast(kind).alias(c)
                for c, kind in (x.split(" ", 1) for x in COLUMNS.split(", "))
                if c != "embedding"
            ]
        )
        self.commit(upsert=self.embedder.embed(full), ids=full.select("id"))

    def update_metadata(self, rows: DataFrame) -> None:
        self.commit(metadata=rows)

    def delete(self, ids: DataFrame) -> None:
        self.commit(delete=ids)

    def count(self) -> int:
        return self.table().count()

    def metadata(self) -> DataFrame:
        return self.table().select("id", *METADATA)

    def drop(self) -> None:
        self._pointer.delete()

    def nearest(self, vector: list[float], k: int) -> DataFrame:
        """The k chunks nearest to a vector by cosine, best first, ties by id; none for k below 1. Chunks without a vector,
        or with one of another length, are left out; zero vectors have similarity 0."""
        q = np.array(vector, np.float64)
        q /= np.linalg.norm(q) or 1.0
        table = self.table()

        def run(batches):
            for b in batches:
                vectors = b.column("embedding")
                fit = np.flatnonzero(np.array(vectors.value_lengths().fill_null(-1)) == len(q))
                b = b.take(pa.array(fit))
                m = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), len(q))
                length = np.sqrt((m * m).sum(axis=1))
                sim = (m * q).sum(axis=1) / np.where(length, length, 1.0)
                by_id = np.argsort(np.array(b.column("id").to_pylist(), object), kind="stable")
                best = by_id[np.argsort(-sim[by_id], kind="stable")[: max(0, k)]]
                yield b.take(pa.array(best)).append_column("similarity", pa.array(sim[best]))

        hits = table.mapInArrow(run, T.StructType([*table.schema.fields, T.StructField("similarity", T.DoubleType())]))
        return hits.orderBy(F.desc("similarity"), "id").limit(max(0, k))

    def query(self, text: str, k: int = 5) -> DataFrame:
        if k <= 0:
            return self.table().withColumn("similarity", F.lit(None).cast("double")).limit(0)
        return self.nearest(self.embedder.query_vector(text), k)
