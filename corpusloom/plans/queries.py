"""The core's queries, by name."""

from __future__ import annotations

import json
import os
import socket
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import parser as cli_parser
from ..config import Config
from ..functions.buckets import sha2_bucket
from ..functions.text import ascii_tokens, content_hash, decode_utf8, is_blank, strip
from ..functions.vectors import cosine, score
from ..lock import is_stale
from ..operators.chunking import chunk
from ..operators.embed import HashEmbedder, embedder, neural, sparse, with_query_similarity
from ..operators.ingest import ingest, stored_chunks
from ..operators.search import batch_top_k, bounded_k, citation_json, lexically_within, refusals, search_knowledge, top_k
from ..operators.sizes import spread
from ..operators.snapshot_diff import latest_deliveries, snapshot_changes
from ..operators.snapshots import chunk_key, parse_series, series_files, shown_dates, snapshot_plan, span_signatures
from ..operators.store import ChunkStore
from ..scratch import scratch_path
from ..server import ToolServer
from ..sources.files import EXCLUDED, corpus_files, write_files

Query = Callable[[SparkSession, str], DataFrame]
QUESTION = "Which crew measures the shared signal of the relay pump?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# --- sources and text ---


def content_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = decode_utf8(F.col("content"))
    rows = table(spark, sf_dir, "files").select("file_no", "batch_no", text.alias("text")).distinct()
    return rows.select(
        "file_no", "batch_no", F.length("text").cast("long").alias("n_chars"), is_blank(F.col("text")).alias("skipped"), content_hash(F.col("text")).alias("sha256")
    )


#: A prefix left out besides the usual ones, and what stands before or behind some rels to try the selection.
EXTRA_PREFIX = "drafts/gear"


def corpus_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as a folder, under names of all kinds, and read as a corpus."""
    kind = F.col("doc_id") % 9
    name = F.when(kind == 1, F.concat(F.lit("_x/.y/"), "rel")).when(kind == 2, F.concat(F.lit("Routines/Wikilink Scan"), "rel"))
    name = name.when(kind == 3, F.concat(F.lit("infrastructure/claude-config-backup/"), "rel")).when(kind == 4, F.concat("rel", F.lit(".MARKDOWN")))
    name = name.when(kind == 5, F.concat("rel", F.lit(".txt"))).when(kind == 6, F.concat(F.lit("drafts/"), "rel")).when(kind == 7, F.concat(F.lit("a[1]/b c%20/"), "rel"))
    rows = table(spark, sf_dir, "documents").where("rel is not null").select(name.otherwise(F.col("rel")).alias("rel"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    root = scratch_path(spark, "corpus")
    write_files(rows, root)
    return corpus_files(spark, root, exclude=EXCLUDED + (EXTRA_PREFIX,)).select("rel", F.md5("content").alias("md5"))


def skip_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(is_blank(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n_chars"))


# --- chunks ---


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select(
        "doc_id", "chunk_index", "heading", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(F.lower("lang"), F.lit("none")).alias("label")
    return _chunked(spark, sf_dir).groupBy(label).agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars"), F.max("chunk_index").alias("last_index")
    )


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "chunks").select("id", chunk_key(F.col("heading"), F.col("text")).alias("key"))
    return keyed.groupBy("key").agg(F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"))


# --- vectors ---


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(ascii_tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(ascii_tokens(F.col("text"))).alias("token"))
    return words.groupBy(sha2_bucket(F.col("token"), 256).alias("bucket")).agg(F.count("*").alias("n"))


def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sparse(rows, ["doc_id"]).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


#: Words whose BLAKE2b buckets the SQL knows.
GOLDEN = "the a of and to in is it for on that with as at by from this pump valve relay crew gate signal shift log note check open closed night day dog cat barks x1 2026".split()


def hash_embed_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense embedding of every document's GOLDEN words: (doc_id, bucket, weight) of the entries that are not zero."""
    words = F.filter(ascii_tokens(F.col("text")), lambda w: w.isin(GOLDEN))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("text"))
    made = HashEmbedder().embed(rows).select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0")
    return made.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 3).alias("weight"))


def hash_embed_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HashEmbedder().embed(_chunked(spark, sf_dir).select("doc_id", "chunk_index", "text")).drop("text")


def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.orderBy("vec_id").select("embedding").first()[0]
    q = F.array(*[F.lit(float(x)) for x in first])
    return top_k(rows, cosine(F.col("embedding"), q), 10, "vec_id").select("vec_id", score(F.col("similarity")).alias("score"))


def topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    best = batch_top_k(asked, rows, 5, row_id="vec_id")
    return best.select("query_id", "vec_id", score(F.col("similarity")).alias("score"), F.col("rank").cast("long").alias("rank"))


def topk_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth chunk with a vector against all chunks: chunks have short vectors, so ties are common."""
    rows = table(spark, sf_dir, "chunks").where("embedding is not null").groupBy("id").agg(F.min("embedding").alias("embedding"))
    asked = rows.where(F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(100)) == 0).withColumnRenamed("id", "query_id")
    best = batch_top_k(asked, rows, 3)
    return best.groupBy("query_id").agg(F.round(F.min("similarity"), 3).alias("third"), F.count("*").alias("hits"))


# --- search ---


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chunk, embed and rank in one pass over the documents, without a shuffle before the last five rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "rel", "text")
    hits = with_query_similarity(chunk(docs), QUESTION).withColumn("score", F.round("similarity", 4))
    best = hits.orderBy(F.desc("score"), "doc_id", "chunk_index").limit(5)
    nothing = F.lit(None).cast("string")
    cited = citation_json(F.col("rel"), F.col("heading"), F.col("chunk_index"), nothing, F.lit(None).cast("int"), nothing)
    return best.select("doc_id", "chunk_index", "score", cited.alias("citation"))


def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources lie inside the corpus root, for the notes' own paths and for paths that leave and come back."""
    rels = table(spark, sf_dir, "files").select("file_no", "rel").distinct()
    forms = F.array(
        F.col("rel"), F.concat(F.lit("../"), "rel"), F.concat(F.lit("../vault/"), "rel"), F.concat(F.lit("/srv/vault/"), "rel"), F.concat(F.lit("/srv/vault2/"), "rel"), F.concat(F.lit("a/./../"), "rel"), F.lit("")
    )
    rows = rels.select("file_no", F.posexplode(forms).alias("form", "source"))
    return rows.select("file_no", "form", lexically_within("/srv/vault", F.col("source")).alias("inside"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("id", "source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates")
    return rows.select("id", citation_json(*[F.col(c) for c in ("source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates")]).alias("citation")).distinct()


def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text taken as a query: what the search would say to it before it looks anything up."""
    return refusals(table(spark, sf_dir, "documents").select("doc_id", "text"))


def clamp_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["-3", "0", "1", "5", "20", "21", "1000", "", "ten", "1e400"]
    return spark.createDataFrame([(i, x, bounded_k(x)) for i, x in enumerate(asked)], "n int, asked string, k int")


#: What is asked, and how many answers; one asks for more than there may be.
QUESTIONS = [(QUESTION, 7), ("the pump", 3), ("relay relay relay valve", 99), ("which gate is closed at night and why", None), ("zzzz qqqq", 2)]


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search contract on a real store of all documents, a third of them outside the corpus root: an answer a row."""
    store = ChunkStore(spark, None, "knowledge", HashEmbedder(256, "hash-sha2", "sha2"))
    source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../outside/"), "rel")).otherwise(F.col("rel"))
    rows = chunk(table(spark, sf_dir, "documents").where("text is not null and rel is not null").select(source.alias("source"), "text"))
    store.add(rows.withColumn("id", F.concat("source", F.lit("::"), "chunk_index")))
    out = []
    for i, (q, k) in enumerate(QUESTIONS):
        a = search_knowledge(q, k, store=store, corpus_root="/srv/vault")
        scores = [round(r["score"], 3) for r in a["results"]]
        inside = all(not r["citation"]["source"].startswith("..") and set(r) == {"text", "citation", "score"} for r in a["results"])
        out.append((i, a["ok"], a["query"], a["k"], a["count"], a["dropped_out_of_scope"], max(scores, default=None), min(scores, default=None), inside and scores == sorted(scores, reverse=True)))
    return spark.createDataFrame(out, "n int, ok boolean, query string, k int, count int, dropped int, best double, worst double, in_order boolean")


def search_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search answers to calls that cannot be met, in the order in which it looks at them."""

    class Down:
        def count(self):
            raise OSError("no such store")

    class Fails(Down):
        def count(self):
            return 1

        def query(self, *_):
            raise OSError("gone")

    empty = ChunkStore(spark, None, "knowledge", HashEmbedder(8))
    tools = ToolServer(lambda: (empty, "/srv/vault"))
    calls = [
        ("null", None, 5, empty), ("blank", " \n\u00a0", 5, empty), ("number", 7, 5, empty), ("too long", "x" * 4001, 5, empty), ("longest", "x" * 4000, 5, empty), ("invalid before down", "", 5, Down()),
        ("down", "pump", 50, Down()), ("fails", "pump", "3", Fails()), ("empty", "pump", -1, empty), ("infinite k", "pump", float("inf"), empty), ("no k", "pump", "ten", empty),
    ]
    answers = [(name, search_knowledge(q, k, store=s, corpus_root="/srv/vault")) for name, q, k, s in calls]
    answers += [("other tool", json.loads(tools.call_tool("other", {}))), ("tool", json.loads(tools.call_tool("search_knowledge", {"query": "pump", "k": 2.9})))]

    def broken():
        raise ValueError("not set")

    answers.append(("configuration", json.loads(ToolServer(broken).call_tool("search_knowledge", {"query": "pump"}))))
    rows = [(name, a["ok"], a["error"]["type"], a.get("k"), len(a["results"])) for name, a in answers]
    return spark.createDataFrame(rows, "case_name string, ok boolean, type string, k int, results int")


def store_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stores, embedders, locks, settings and parameters do at their limits: one outcome a row."""
    out = []

    def tried(name, f):
        try:
            said = f()
        except Exception as e:  # noqa: BLE001
            said = type(e).__name__
        out.append((name, str(said)))

    path = scratch_path(spark, "guarded")
    one = spark.createDataFrame([("a.md::0", "a.md", 0, "the pump")], "id string, source string, chunk_index int, text string")
    first = ChunkStore(spark, path, "knowledge", HashEmbedder(16))
    first.add(one)
    tried("count", first.count)
    tried("other dimension", lambda: ChunkStore(spark, path, "knowledge", HashEmbedder(32)))
    tried("other collection", lambda: ChunkStore(spark, path, "notes", HashEmbedder(32)).count())
    tried("opened again", lambda: ChunkStore(spark, path, "knowledge", HashEmbedder(16)).count())
    tried("add nothing", lambda: first.add(one.limit(0)) or first.count())
    tried("delete unknown", lambda: first.delete(one.select(F.lit("b.md::0").alias("id"))) or first.count())
    tried("no answers for k 0", lambda: first.query("pump", 0).count())
    tried("manifest of none", lambda: first.manifest()[0].count())
    tried("overlap too large", lambda: chunk(one, max_chars=100, overlap=100))
    tried("unknown embedder", lambda: embedder("other"))
    tried("weights absent", lambda: embedder("bge").query_vector("pump"))
    asked = []
    loaded = neural("own", 3, lambda: lambda texts: asked.extend(texts) or [[1.0, 0.0, 0.0] for _ in texts], prefix="Find: ")
    tried("prefix on queries alone", lambda: (loaded.query_vector("pump"), loaded.vectors(["pump"]), asked)[2])
    tried("settings missing", lambda: Config.from_env({"CORPUSLOOM_CORPUS_ROOT": "/srv/vault"}))
    given = {"CORPUSLOOM_CORPUS_ROOT": "/srv/vault", "CORPUSLOOM_DB_PATH": "/srv/store"}
    tried("settings", lambda: (lambda c: (c.collection, c.embedder_name))(Config.from_env(given)))
    tried("settings with a wrong embedder", lambda: Config.from_env(given | {"CORPUSLOOM_EMBEDDER": "other"}))
    now = datetime.now(timezone.utc)
    holder = {"pid": os.getpid(), "acquired": now.isoformat(), "host": socket.gethostname()}
    for name, h in (("live", holder), ("none", None), ("dead", holder | {"pid": -1}), ("no time", holder | {"acquired": "?"}), ("old", holder | {"acquired": (now - timedelta(hours=7)).isoformat()}), ("elsewhere", holder | {"pid": -1, "host": "other"})):
        tried(f"lock {name} stale", lambda h=h: is_stale(h))
    tried("command without a verb", lambda: cli_parser().parse_args(["ingest", "/srv/vault", "--db", "/srv/store", "--exclude", "x/", "--quiet"]).exclude)
    tried("tool schema", lambda: [(t["name"], t["inputSchema"]["required"]) for t in ToolServer(lambda: None).list_tools()])
    return spark.createDataFrame(out, "case_name string, outcome string")


# --- dated series ---


def series_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = table(spark, sf_dir, "manifest").select("rel").unionByName(table(spark, sf_dir, "snapshot_chunks").select("rel")).distinct()
    series, date = parse_series(F.col("rel"))
    return rels.select("rel", series.alias("series"), date.alias("snapshot_date"))


def series_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = series_files(table(spark, sf_dir, "snapshot_chunks").select("rel"))
    return files.select("rel", "series", "snapshot_date", F.col("n").cast("long").alias("n"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_deliveries(table(spark, sf_dir, "snapshot_chunks").where("rel is not null"))
    keyed = rows.select("rel", "chunk_index", chunk_key(F.col("heading"), F.col("text")).alias("key")).distinct()
    return snapshot_plan(series_files(rows), keyed)


def snapshot_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("rel", "chunk_index", "owner_rel", "owner_index", "is_kept", F.array_join("repeat_dates", ",").alias("dates"))


def snapshot_plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan where every third file of a series has no chunks: the file after it keeps everything."""
    rows = latest_deliveries(table(spark, sf_dir, "snapshot_chunks").where("rel is not null"))
    series = series_files(rows)
    keyed = rows.join(series.where("n % 3 = 0"), "rel", "left_anti").select("rel", "chunk_index", chunk_key(F.col("heading"), F.col("text")).alias("key")).distinct()
    return snapshot_plan(series, keyed).select("rel", "chunk_index", "owner_rel", "owner_index", "is_kept", F.array_join("repeat_dates", ",").alias("dates"))


def snapshot_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_signatures(_plan(spark, sf_dir))


def snapshot_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "snapshot_plan").where("is_kept").distinct()
    return kept.select("rel", "chunk_index", shown_dates(F.col("repeat_dates")).alias("shown"), (F.size("repeat_dates") + 1).alias("repeat_count"))


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, _ = parse_series(F.col("rel"))
    plan = table(spark, sf_dir, "snapshot_plan").distinct().withColumn("series", series)
    return plan.groupBy("series").agg(F.count("*").alias("chunks"), F.sum(F.when(~F.col("is_kept"), 1).otherwise(0)).alias("suppressed"))


# --- manifest and store ---


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "manifest").select("rel", F.lower(strip(F.col("sha256"))).alias("sha256"), "chunks", "kept", "spanh")
    return rows.groupBy("rel").agg(F.max(F.struct("sha256", "chunks", "kept", "spanh")).alias("m")).select("rel", "m.*")


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest against the files of all batches, of each rel the last delivered."""
    text = decode_utf8(F.col("content"))
    now = table(spark, sf_dir, "files").select("rel", "batch_no", "file_no", text.alias("text")).where(~is_blank(F.col("text")))
    now = now.groupBy("rel").agg(F.max(F.struct("batch_no", "file_no", content_hash(F.col("text")).alias("sha"))).getField("sha").alias("sha"))
    both = now.join(_manifest(spark, sf_dir).select("rel", "sha256", F.lit(True).alias("known")), "rel", "full")
    state = (
        F.when(F.col("sha").isNull(), "gone").when(F.col("known").isNull(), "new").when(F.col("sha") == F.col("sha256"), "unchanged").otherwise("changed")
    )
    return both.select("rel", state.alias("state"))


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = manifest_diff(spark, sf_dir)
    return state.agg(*[F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(f"files_{s}") for s in ("new", "changed", "unchanged", "gone")])


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_chunks(_manifest(spark, sf_dir)).select(F.concat("rel", F.lit("::"), F.col("chunk_index").cast("string")).alias("id"))


def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).join(table(spark, sf_dir, "chunks").select("id"), "id", "left_anti").distinct()


def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id").join(_ids(spark, sf_dir), "id", "left_anti").distinct()


# An ingest of a folder in three runs. Notes are the files of batches 0 to 4, then, with the changes below, of all; dated
# files are made of the snapshots' sections, at first three in four of them.


def _folder(spark: SparkSession, sf_dir: str, run: int) -> str:
    notes = table(spark, sf_dir, "files").select("file_no", "batch_no", F.concat(F.lit("notes/"), "rel").alias("rel"), "content").distinct()
    if run == 1:
        notes = notes.where("batch_no <= 4")
    else:
        edited = F.concat("content", F.lit("\n\n# Added\n\nOne more line.\n").cast("binary"))
        notes = notes.where("file_no % 7 <> 0").withColumn("content", F.when(F.col("file_no") % 5 == 0, edited).otherwise(F.col("content")))
    rows = table(spark, sf_dir, "snapshot_chunks").where("rel is not null")
    if run == 1:
        rows = rows.where(F.substring(F.md5(F.col("rel").cast("binary")), 1, 1) < "c")
    part = F.concat(F.lit("## "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    parts = latest_deliveries(rows).select("rel", F.struct("chunk_index", F.coalesce("heading", F.lit("")).alias("h"), part.alias("part")).alias("p")).distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n")
    dated = parts.groupBy("rel").agg(text.cast("binary").alias("content"))
    root = scratch_path(spark, "vault")
    write_files(notes.select("rel", "content").unionByName(dated.select(F.concat(F.lit("dated/"), "rel").alias("rel"), "content")), root)
    return root


def _ingested(spark: SparkSession, sf_dir: str, runs: tuple[int, ...]):
    """The store after these runs and the report of each."""
    path, roots, reports = scratch_path(spark, "ingested"), {}, []
    for run in runs:
        roots[min(run, 2)] = roots.get(min(run, 2)) or _folder(spark, sf_dir, run)
        store = ChunkStore(spark, path, "knowledge", HashEmbedder(16))
        report = ingest(spark, roots[min(run, 2)], store)
        reports.append({"run": run} | report.__dict__ | {"store_count": store.count()})
    return store, reports


def ingest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of a first ingest, of one after edits, deletions and new files, and of one that finds nothing changed."""
    _, reports = _ingested(spark, sf_dir, (1, 2, 3))
    ddl = "run int, files_seen int, files_ingested int, files_unchanged int, files_skipped int, chunks_added int, chunks_deleted int, chunks_deduped int, incremental boolean, store_count int"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in reports], ddl)


def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after the second run."""
    manifest, _ = _ingested(spark, sf_dir, (1, 2))[0].manifest()
    return manifest.select("rel", "sha256", "chunks", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), "spanh")


def ingest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after the second run."""
    rows = _ingested(spark, sf_dir, (1, 2))[0].table()
    return rows.select("id", "source", "heading", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "snapshot_date", "repeat_count", "repeat_dates", F.size("embedding").alias("dim"))


def _stored(spark: SparkSession, sf_dir: str, collection: str) -> tuple[ChunkStore, DataFrame]:
    """A store with a collection's chunks as first ingested, and the later rows of ids that came twice."""
    rows = table(spark, sf_dir, "chunks").where(F.col("collection") == collection)
    at = F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    edge = rows.groupBy("id").agg(F.min(F.struct(at.alias("at"), F.coalesce("heading", F.lit("")).alias("heading"))).alias("first"))
    marked = rows.join(edge, "id").withColumn("is_first", (at == F.col("first.at")) & (F.coalesce("heading", F.lit("")) == F.col("first.heading")))
    store = ChunkStore(spark, None, collection, HashEmbedder(8))
    store.commit(upsert=marked.where("is_first"))
    return store, marked.where("not is_first")


def _each(spark: SparkSession, sf_dir: str, show) -> DataFrame:
    """What show(store, later rows) gives for the store of each collection, with the collection's name. The stores have
    nothing to do with each other, so their jobs are submitted side by side."""
    names = sorted(r[0] for r in table(spark, sf_dir, "run_identity").select("collection").distinct().collect())
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda name: show(*_stored(spark, sf_dir, name)).select(F.lit(name).alias("collection"), "*"), names))
    return reduce(DataFrame.unionByName, made)


def _shown(store: ChunkStore) -> DataFrame:
    return store.table().select("id", F.coalesce("heading", F.lit("")).alias("heading"), "repeat_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda store, later: store.commit(upsert=later) or _shown(store))


def delete_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda store, _: store.delete(store.table().where("chunk_index % 5 = 0").select("id")) or _shown(store))


def refresh_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    def show(store: ChunkStore, _: DataFrame) -> DataFrame:
        new = store.metadata().where("snapshot_date is not null").withColumn("repeat_count", F.col("repeat_count") + 1)
        store.update_metadata(new)
        return _shown(store)

    return _each(spark, sf_dir, show)


def store_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda store, _: store.metadata().groupBy("source").agg(F.count("*").alias("chunks")))


def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda store, _: spark.createDataFrame([(store.count(),)], "chunks long"))


# --- problem 2 ---


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshot_chunks"))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with the hashes of the old and new values."""
    changes = snapshot_changes(table(spark, sf_dir, "snapshot_chunks"), with_values=True)
    return changes.select(
        "series", "snapshot_date", "heading", "change_kind", F.md5(F.col("old_text").cast("binary")).alias("old_md5"), F.md5(F.col("new_text").cast("binary")).alias("new_md5")
    )


_helpers = {"table"}


def queries() -> dict[str, Query]:
    from inspect import isfunction

    mine = {k: v for k, v in globals().items() if isfunction(v) and v.__module__ == __name__ and k[0] != "_"}
    return {k: v for k, v in mine.items() if k not in _helpers | {"queries"}}
