"""Incremental ingest of a folder of markdown into a chunk store.

Files are compared with the manifest by the hash of their text before anything is chunked or embedded; what changed is
chunked, snapshot repeats are taken out, missing chunks embedded, stale ones deleted, metadata rewritten where it moved,
and all of it committed with the new manifest in one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, decode_utf8, is_blank
from ..scratch import staged
from ..sources.files import EXCLUDED, EXTENSIONS, corpus_files, is_folder
from .chunking import MAX_CHARS, OVERLAP, chunk
from .embed import Embedder
from .snapshots import chunk_key, series_files, shown_dates, snapshot_plan, span_signatures
from .store import ChunkStore


@dataclass(frozen=True)
class RunIdentity:
    """What a chunk's vector depends on beside its text. A manifest made under another one is not used."""

    embedder: str
    embed_dim: int
    collection: str
    max_chars: int
    overlap: int

    @classmethod
    def of(cls, e: Embedder, collection: str, max_chars: int, overlap: int) -> RunIdentity:
        return cls(e.name, e.dim, collection, max_chars, overlap)


@dataclass
class IngestReport:
    files_seen: int = 0
    files_ingested: int = 0
    files_unchanged: int = 0
    files_skipped: int = 0
    chunks_added: int = 0
    chunks_deleted: int = 0
    chunks_deduped: int = 0
    incremental: bool = False


def chunk_id():
    return F.concat("rel", F.lit("::"), F.col("chunk_index").cast("string"))


def stored_chunks(manifest: DataFrame) -> DataFrame:
    """manifest -> (rel, chunk_index) of the chunks it says are stored: those kept, else all."""
    every = F.when(F.col("chunks") > 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array().cast("array<int>"))
    return manifest.select("rel", F.explode(F.coalesce("kept", every)).alias("chunk_index"))


def ingest(
    spark: SparkSession,
    root: str,
    store: ChunkStore,
    *,
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    extensions: tuple[str, ...] = EXTENSIONS,
    exclude: tuple[str, ...] = EXCLUDED,
    incremental: bool = True,
    dedupe_snapshots: bool = True,
    keep_unreadable: bool = False,
) -> IngestReport:
    """Bring the store in line with the folder.

    A file that is unreadable or blank is skipped, and what it had stored is deleted as if the file were gone;
    keep_unreadable keeps the chunks of files that cannot be decoded. Without a manifest to trust (incremental off,
    another identity, an empty store, scratch storage) the whole table is made anew.
    """
    if not is_folder(root):
        raise NotADirectoryError(f"the corpus root {root!r} is no directory; nothing was changed")
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")
    identity = RunIdentity.of(store.embedder, store.collection, max_chars, overlap)
    manifest, made_under = store.manifest()
    trusted = incremental and store.persistent and made_under == identity.__dict__ and not store.table().isEmpty()
    if not trusted:
        manifest = manifest.limit(0)
    manifest = manifest.dropDuplicates(["rel"])

    source = corpus_files(spark, root, extensions, exclude)
    texts = source.select("rel", decode_utf8(F.col("content")).alias("text"))
    seen = staged(texts.select("rel", F.when(~is_blank(F.col("text")), content_hash(F.col("text"))).alias("sha256"), F.col("text").isNull().alias("unreadable")), "files-seen")
    series = series_files(seen) if dedupe_snapshots else series_files(seen.limit(0))
    series = staged(series, "series")

    old = manifest.select("rel", F.col("sha256").alias("old_sha"), F.col("chunks").alias("old_chunks"), F.col("kept").alias("old_kept"), F.col("spanh").alias("old_spanh"))
    readable = seen.where("sha256 is not null").join(old, "rel", "left").join(series.select("rel", F.lit(True).alias("in_series")), "rel", "left")
    readable = staged(
        readable.withColumn("same", F.coalesce(F.col("old_sha") == F.col("sha256"), F.lit(False))).withColumn(
            "fast", F.col("same") & F.col("in_series").isNull() & F.col("old_kept").isNull()
        ),
        "files-readable",
    )
    if trusted:
        # Nothing new, changed, vanished or in a series, and no dates stored that a series once had: nothing to do.
        held_files, n_seen = manifest.count(), seen.count()
        fast, rest = readable.agg(F.count_if("fast"), F.count_if(~F.col("fast"))).first()
        if fast == held_files and not rest and store.table().where("snapshot_date is not null").isEmpty():
            return IngestReport(files_seen=n_seen, files_unchanged=fast, files_skipped=n_seen - fast, incremental=held_files > 0)
    todo = readable.where("not fast")
    # The hash that goes with the chunks is that of the text they were cut from: a file may have changed since it was seen.
    again = texts.join(todo.select("rel"), "rel", "left_semi").withColumn("sha256", content_hash(F.col("text")))
    chunks = chunk(again, max_chars=max_chars, overlap=overlap)
    chunks = staged(chunks.withColumn("key", chunk_key(F.col("heading"), F.col("text"))), "chunks")

    todo = todo.drop("sha256").join(chunks.groupBy("rel").agg(F.first("sha256").alias("sha256")), "rel")
    todo = todo.withColumn("same", F.coalesce(F.col("old_sha") == F.col("sha256"), F.lit(False)))
    plan = staged(snapshot_plan(series, chunks), "snapshot-plan")
    dates = plan.select("rel", "chunk_index", "is_kept", "snapshot_date", "repeat_dates")
    selected = chunks.drop("key", "sha256").join(dates, ["rel", "chunk_index"], "left").where("is_kept is null or is_kept")
    selected = selected.select(
        chunk_id().alias("id"),
        "rel",
        "chunk_index",
        F.coalesce("heading", F.lit("")).alias("heading"),
        "text",
        "snapshot_date",
        F.when(F.col("snapshot_date").isNotNull(), F.size("repeat_dates") + 1).cast("int").alias("repeat_count"),
        F.when(F.col("snapshot_date").isNotNull(), shown_dates(F.col("repeat_dates"))).alias("repeat_dates"),
    )
    selected = staged(selected, "chunks-selected")
    stored = stored_chunks(manifest).withColumn("there", F.lit(True))
    same = todo.select("rel", "same")
    marked = selected.join(same, "rel").join(stored, ["rel", "chunk_index"], "left")
    to_add = staged(marked.where("not same or there is null").drop("same", "there"), "chunks-to-add")

    alive = chunks.select("rel").distinct().unionByName(readable.where("fast").select("rel"))
    if keep_unreadable:
        alive = alive.unionByName(seen.where("unreadable").select("rel"))
    alive = alive.distinct()
    fast_or_kept = alive.join(chunks.select("rel").distinct(), "rel", "left_anti")
    stale = stored.join(selected.select("rel", "chunk_index"), ["rel", "chunk_index"], "left_anti").join(fast_or_kept, "rel", "left_anti")
    stale = staged(stale.select(chunk_id().alias("id")), "chunks-stale")

    # Metadata follows the plan on every run, also where only the plan, or the use of one, has changed.
    held = store.table().select("id", "source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates") if trusted else store.table().limit(0).select("id", "source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates")
    now = selected.join(to_add.select("id"), "id", "left_anti").select(
        "id", F.col("snapshot_date").alias("d"), F.col("repeat_count").alias("c"), F.col("repeat_dates").alias("r")
    )
    dated = held.where("snapshot_date is not null").join(readable.where("fast").select(F.col("rel").alias("source")), "source", "left_semi")
    plain = dated.select("id", F.lit(None).cast("string").alias("d"), F.lit(None).cast("int").alias("c"), F.lit(None).cast("string").alias("r"))
    moved = held.join(now.unionByName(plain), "id").where("not (snapshot_date <=> d and repeat_count <=> c and repeat_dates <=> r)")
    moved = moved.select("id", "source", "heading", "chunk_index", F.col("d").alias("snapshot_date"), F.col("c").alias("repeat_count"), F.col("r").alias("repeat_dates"))

    per_file = chunks.groupBy("rel").agg(F.count("*").cast("int").alias("chunks"))
    chosen = selected.groupBy("rel").agg(F.array_sort(F.collect_list("chunk_index")).alias("kept"))
    done = (
        todo.join(per_file, "rel")
        .join(chosen, "rel", "left")
        .join(span_signatures(plan), "rel", "left")
        .join(to_add.groupBy("rel").agg(F.count("*").alias("added")), "rel", "left")
        .withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    )
    new_manifest = done.select(
        "rel", "sha256", "chunks", F.when(F.size("kept") != F.col("chunks"), F.col("kept")).alias("kept"), "spanh"
    ).unionByName(readable.where("fast").select("rel", "sha256", F.col("old_chunks").alias("chunks"), F.lit(None).cast("array<int>").alias("kept"), F.lit(None).cast("string").alias("spanh")))
    if keep_unreadable:
        new_manifest = new_manifest.unionByName(manifest.join(seen.where("unreadable").select("rel"), "rel", "left_semi"))
    new_manifest = staged(new_manifest, "manifest")

    report = IngestReport(incremental=bool(trusted and not manifest.isEmpty()))
    report.files_seen = seen.count()
    fast = readable.where("fast").count()
    files = done.agg(
        F.count("*"), F.sum(F.when(F.col("same") & F.col("added").isNull(), 1).otherwise(0)), F.sum("added")
    ).first()
    report.files_unchanged = fast + (files[1] or 0)
    report.files_ingested = files[0] - (files[1] or 0)
    report.files_skipped = report.files_seen - fast - files[0]
    report.chunks_added = files[2] or 0
    report.chunks_deleted = stale.count() if trusted else 0
    report.chunks_deduped = plan.where("not is_kept").count()

    rows = to_add.select("id", F.col("rel").alias("source"), "heading", "chunk_index", "text", "snapshot_date", "repeat_count", "repeat_dates")
    store.commit(
        upsert=store.embedder.embed(rows) if report.chunks_added else None,
        ids=to_add.select("id") if report.chunks_added else None,
        rows=report.chunks_added,
        delete=stale if report.chunks_deleted else None,
        metadata=None if moved.isEmpty() else staged(moved, "metadata"),
        manifest=new_manifest if store.persistent else None,
        identity=identity.__dict__,
        replace=not trusted,
    )
    return report
