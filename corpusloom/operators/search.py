"""Bounded, scoped, cited retrieval that answers every call with a structure and never raises."""

from __future__ import annotations

import os
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import score

MAX_K, DEFAULT_K, MAX_QUERY = 20, 5, 4000


def bounded_k(k: Any) -> int:
    """k as an integer in 1..MAX_K; DEFAULT_K for what is no number, infinities among it."""
    try:
        k = int(k)
    except (TypeError, ValueError, OverflowError):
        k = DEFAULT_K
    return max(1, min(k, MAX_K))


def within_root(root: str, source: str) -> bool:
    """Whether source, taken from root with links followed, lies inside root."""
    if not source:
        return False
    try:
        top = os.path.realpath(root)
        full = os.path.realpath(os.path.join(top, source))
    except (OSError, ValueError):
        return False
    return full == top or full.startswith(top.rstrip("/") + "/")


def lexically_within(root: str, source: Column) -> Column:
    """within_root as an expression, without following links: . and .. are folded as text."""
    root = os.path.normpath(root)
    full = F.when(source.startswith("/"), source).otherwise(F.concat(F.lit(root + "/"), source))

    def fold(parts: Column, x: Column) -> Column:
        up = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))
        shorter = F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))
        return F.when(x.isin("", "."), parts).when(x == "..", shorter).otherwise(F.array_append(parts, x))

    folded = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), fold, lambda a: F.concat(F.lit("/"), F.array_join(a, "/")))
    inside = (folded == root) | folded.startswith(root.rstrip("/") + "/")
    return F.coalesce((source != "") & inside, F.lit(False))


def error(kind: str, message: str, k: int | None = None) -> dict[str, Any]:
    out: dict[str, Any] = {"ok": False, "error": {"type": kind, "message": message}, "results": []}
    return out if k is None else out | {"k": k}


def citation(row: dict) -> dict[str, Any]:
    """Where a chunk stands; for a chunk of a snapshot its date and, if it repeats, the later dates it stands for."""
    out = {"source": row["source"] or "", "heading": row["heading"] or None, "chunk_index": row["chunk_index"]}
    if row.get("snapshot_date"):
        out["snapshot_date"] = row["snapshot_date"]
        if row.get("repeat_dates"):
            out["also_unchanged_on"] = row["repeat_dates"]
            out["snapshots_covered"] = row["repeat_count"]
    return out


def citation_json(source: Column, heading: Column, chunk_index: Column, date: Column, count: Column, dates: Column) -> Column:
    """citation() as a JSON expression, for results in bulk."""
    has_date = F.coalesce(date, F.lit("")) != ""
    has_more = has_date & (F.coalesce(dates, F.lit("")) != "")
    plain = F.struct(source.alias("source"), F.nullif(heading, F.lit("")).alias("heading"), chunk_index.alias("chunk_index"))
    dated = F.struct(plain["source"].alias("source"), plain["heading"].alias("heading"), plain["chunk_index"].alias("chunk_index"), date.alias("snapshot_date"))
    full = F.struct(*[dated[c].alias(c) for c in ("source", "heading", "chunk_index", "snapshot_date")], dates.alias("also_unchanged_on"), count.alias("snapshots_covered"))
    show = lambda s: F.to_json(s, {"ignoreNullFields": "false"})
    return F.when(has_more, show(full)).when(has_date, show(dated)).otherwise(show(plain))


def refusal(query: Any) -> dict[str, Any] | None:
    """What is wrong with a query, as an answer; None if nothing is."""
    if not isinstance(query, str) or not query.strip():
        return error("invalid_query", "a query is text that is not blank")
    if len(query) > MAX_QUERY:
        return error("invalid_query", f"query has {len(query)} characters; at most {MAX_QUERY} are allowed")
    return None


def refusals(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with `verdict`: what search_knowledge says to each taken as a query, before it looks anything up; or ok."""
    schema = T.StructType([*[f for f in texts.schema.fields if f.name != text], T.StructField("verdict", T.StringType())])

    def run(batches):
        for b in batches:
            said = [refusal(x) for x in b.column(text).to_pylist()]
            verdict = pa.array([x["error"]["type"] if x else "ok" for x in said], pa.string())
            yield b.drop_columns([text]).append_column("verdict", verdict)

    return texts.mapInArrow(run, schema)


def search_knowledge(query: Any, k: Any = DEFAULT_K, *, store: Any, corpus_root: str) -> dict[str, Any]:
    """The k nearest chunks with citations; those whose source lies outside corpus_root are dropped and counted.

    The scope is applied after the k nearest are taken: fewer than k may come back.
    """
    if wrong := refusal(query):
        return wrong
    k = bounded_k(k)
    try:
        if store.count() == 0:
            return error("empty_store", "the store holds no chunks; run an ingest first", k)
    except Exception as e:  # noqa: BLE001
        return error("store_unreachable", f"the store can't be read: {e}", k)
    try:
        hits = [r.asDict() for r in store.query(query, k).drop("embedding").collect()]  # at most MAX_K rows
    except Exception as e:  # noqa: BLE001
        return error("store_unreachable", f"the query failed: {e}", k)
    results = []
    for h in hits:
        if within_root(corpus_root, h["source"] or ""):
            s = h.get("similarity")
            shown = round(max(0.0, s), 4) if isinstance(s, (int, float)) else None
            results.append({"text": h["text"], "citation": citation(h), "score": shown})
    return {"ok": True, "query": query, "k": k, "count": len(results), "dropped_out_of_scope": len(hits) - len(results), "results": results}


def top_k(rows: DataFrame, similarity: Column, k: int, id_: str = "id") -> DataFrame:
    """The k most similar rows, ties by id."""
    return rows.withColumn("similarity", similarity).orderBy(F.desc("similarity"), id_).limit(k)


def batch_top_k(queries: DataFrame, rows: DataFrame, k: int, *, query_id: str = "query_id", row_id: str = "id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """For each query the k most similar rows by cosine: (query_id, row_id, similarity, rank).

    The queries are a stated set: they are taken in blocks of `block` through the driver, each block against all rows as
    one matrix product per batch, which keeps only k rows for each query before anything is shuffled. Vectors that are
    null or of another length than the first query match nothing; zero vectors have similarity 0; ties go by row id.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[row_id]
    ddl = f"query bigint, {row_id} {kind}, similarity double"
    listed = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    out = None

    def part(ids: list, vectors: list) -> DataFrame:
        q = np.array(vectors, np.float64)
        q /= np.where(n := np.linalg.norm(q, axis=1, keepdims=True), n, 1.0)

        def run(batches):
            for b in batches:
                v = b.column(vector).to_pylist()
                fit = [i for i, x in enumerate(v) if x is not None and len(x) == q.shape[1]]
                if not fit:
                    continue
                m = np.array([v[i] for i in fit], np.float64)
                m /= np.where(n := np.linalg.norm(m, axis=1, keepdims=True), n, 1.0)
                row_ids = np.array(b.column(row_id).to_pylist())[fit]
                by_id = np.argsort(row_ids, kind="stable")
                sim = q @ m[by_id].T
                best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                which = np.repeat(np.arange(len(q)), best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which), pa.array(row_ids[by_id][best.ravel()].tolist()), pa.array(sim[which, best.ravel()])], names=["query", row_id, "similarity"]
                )

        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"query bigint, {query_id} {dict(queries.dtypes)[query_id]}")
        near = rows.where(F.col(vector).isNotNull()).select(row_id, vector).mapInArrow(run, ddl)
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), row_id))).where(F.col("rank") <= k)
        return near.join(F.broadcast(names), "query").select(query_id, row_id, "similarity", "rank")

    ids, vectors = [], []
    for r in listed.toLocalIterator():
        if vectors and len(r[1]) != len(vectors[0]):
            continue
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == block:
            out = part(ids, vectors) if out is None else out.unionByName(part(ids, vectors))
            ids, vectors = [], []
    if ids:
        out = part(ids, vectors) if out is None else out.unionByName(part(ids, vectors))
    if out is None:
        return spark.createDataFrame([], f"{query_id} {dict(queries.dtypes)[query_id]}, {row_id} {kind}, similarity double, rank int")
    return out


def shown(hits: DataFrame) -> DataFrame:
    """Hits with a similarity -> (text, citation as JSON, score)."""
    return hits.select(
        "text",
        citation_json(*[F.col(c) for c in ("source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates")]).alias("citation"),
        score(F.col("similarity")).alias("score"),
    )
