from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.buckets import blake2b_bucket, sha2_bucket
from corpusloom.operators.embed import BGE_PREFIX, HashEmbedder, embedder, neural, sparse, with_query_similarity
from corpusloom.operators.search import MAX_QUERY, batch_top_k, bounded_k, citation, citation_json, lexically_within, search_knowledge, within_root
from corpusloom.operators.store import ChunkStore, DimensionMismatchError
from corpusloom.server import TOOL, ToolServer


def test_golden_buckets(spark):
    assert [blake2b_bucket(w, 256) for w in ("dog", "cat", "barks")] == [159, 47, 82]
    assert spark.range(1).select(sha2_bucket(F.lit("abc"), 256)).first()[0] == 191


def test_hash_vectors_have_unit_length_or_are_zero(spark):
    df = spark.createDataFrame([(1, "A dog barks, a cat"), (2, "éé"), (3, None)], "n int, text string")
    got = {r["n"]: r["embedding"] for r in HashEmbedder().embed(df).collect()}
    assert math.isclose(sum(x * x for x in got[1]), 1, abs_tol=1e-6) and not any(got[2]) and not any(got[3])
    assert {r["n"] for r in sparse(df, ["n"]).collect()} == {1}


def test_row_similarity_agrees_with_sparse_vectors(spark):
    df = spark.createDataFrame([(1, "the dog barks at the dog"), (2, "cat"), (3, ""), (4, None)], "n int, text string")
    q = {r["bucket"]: r["weight"] for r in sparse(spark.createDataFrame([("the dog",)], "text string").withColumn("n", F.lit(0)), ["n"]).collect()}
    want: dict = {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    for r in sparse(df, ["n"]).collect():
        want[r["n"]] += r["weight"] * q.get(r["bucket"], 0)
    got = dict(with_query_similarity(df, "the dog").select("n", "similarity").collect())
    assert all(math.isclose(got[n], want[n], abs_tol=1e-9) for n in want)


def test_embedder_registry():
    assert embedder("bge").query_prefix == BGE_PREFIX and embedder("bge").dim == 1024 and embedder("default").dim == 384
    with pytest.raises(ValueError):
        embedder("no such")
    with pytest.raises(RuntimeError):
        embedder("bge").vectors(["x"])


def test_prefix_goes_before_queries_only(spark):
    seen = []

    def load():
        return lambda texts: [seen.append(t) or [1.0, 0.0] for t in texts]

    e = neural("probe", 2, load, prefix="ask: ")
    assert e.query_vector("x") == [1.0, 0.0] and seen == ["ask: x"]
    e.vectors(["doc"])
    assert seen == ["ask: x", "doc"]


@pytest.mark.parametrize("k, want", [(None, 5), ("3", 3), (2.9, 2), (True, 1), (float("nan"), 5), (float("inf"), 5), (-float("inf"), 5), (-1, 1), (0, 1), (1000, 20), ("x", 5)])
def test_bounded_k(k, want):
    assert bounded_k(k) == want


def test_scope(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    (tmp_path / "vault2").mkdir()
    (root / "out").symlink_to(tmp_path / "vault2")
    cases = {"a.md": True, "../vault/a.md": True, "../vault2/x": False, "": False, f"{root}/a.md": True, "/etc/passwd": False, "a/../../b": False}
    for source, want in cases.items():
        assert within_root(str(root), source) is want, source
    assert within_root(str(root), "out/x") is False
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert dict(df.select("s", lexically_within(str(root), F.col("s"))).collect()) == cases


def _store(spark, texts, path=None):
    store = ChunkStore(spark, path, "knowledge", HashEmbedder(64))
    rows = [(f"{s}::0", s, None, 0, t) for s, t in texts]
    store.add(spark.createDataFrame(rows, "id string, source string, heading string, chunk_index int, text string"))
    return store


def test_search_contract(spark, tmp_path):
    store = _store(spark, [("cats.md", "cats purr softly"), ("dogs.md", "dogs bark loudly"), ("../../secret.md", "dogs bark secret")])
    got = search_knowledge("dogs bark", 3, store=store, corpus_root=str(tmp_path))
    assert got["ok"] and got["k"] == 3 and got["count"] == 2 and got["dropped_out_of_scope"] == 1 and got["query"] == "dogs bark"
    assert got["results"][0]["citation"] == {"source": "dogs.md", "heading": None, "chunk_index": 0}
    for bad in ("", "   ", None, 5, "x" * (MAX_QUERY + 1)):
        assert search_knowledge(bad, store=store, corpus_root="/")["error"]["type"] == "invalid_query"
    assert search_knowledge("x" * MAX_QUERY, store=store, corpus_root="/")["ok"]
    empty = ChunkStore(spark, None, "knowledge", HashEmbedder(64))
    assert search_knowledge("x", 50, store=empty, corpus_root="/")["error"]["type"] == "empty_store"

    class Down:
        def count(self):
            raise OSError("gone")

    answer = search_knowledge("x", 50, store=Down(), corpus_root="/")
    assert answer["error"]["type"] == "store_unreachable" and answer["k"] == 20
    server = ToolServer(lambda: (store, str(tmp_path)))
    assert json.loads(server.call_tool("search_knowledge", {"query": "cats"}))["results"][0]["citation"]["source"] == "cats.md"
    assert json.loads(server.call_tool("other", {}))["error"]["type"] == "unknown_tool"
    broken = ToolServer(lambda: 1 / 0)
    assert not broken.warm_up() and json.loads(broken.call_tool(TOOL["name"], None))["error"]["type"] == "config_error"


def test_store_commits(spark, tmp_path, rows):
    path = str(tmp_path / "db")
    store = _store(spark, [("a.md", "one"), ("b.md", "two")], path)
    store.add(spark.createDataFrame([("a.md::0", "a.md", "H", 0, "uno")], "id string, source string, heading string, chunk_index int, text string"))
    again = ChunkStore(spark, path, "knowledge", HashEmbedder(64))
    assert rows(again.table().select("id", "heading", "text")) == [("a.md::0", "H", "uno"), ("b.md::0", None, "two")]
    again.update_metadata(spark.createDataFrame([("b.md::0", "b.md", "N", 0, None, None, None), ("zz::0", "zz", "N", 0, None, None, None)], "id string, source string, heading string, chunk_index int, snapshot_date string, repeat_count int, repeat_dates string"))
    again.delete(spark.createDataFrame([("a.md::0",), ("none::1",)], "id string"))
    assert rows(store.table().select("id", "heading", "text")) == [("b.md::0", "N", "two")]
    with pytest.raises(DimensionMismatchError):
        ChunkStore(spark, path, "knowledge", HashEmbedder(8))
    ChunkStore(spark, path, "other", HashEmbedder(8))
    assert store.query("two", 0).count() == 0 and store.query("two", 1).count() == 1


def test_citation_forms_agree(spark):
    cases = [("a", "H", 1, None, None, None), ("a", "", 1, "2026-01-01", 1, ""), ("a", None, 2, "2026-99-99", 3, "2026-01-02,2026-01-03")]
    names = ["source", "heading", "chunk_index", "snapshot_date", "repeat_count", "repeat_dates"]
    df = spark.createDataFrame(cases, "source string, heading string, chunk_index int, snapshot_date string, repeat_count int, repeat_dates string")
    for r in df.withColumn("j", citation_json(*[F.col(c) for c in names])).collect():
        assert json.loads(r["j"]) == citation(r.asDict())


def test_batch_top_k_against_all_pairs(spark):
    import random

    rnd = random.Random(1)
    data = [(i, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i in range(60)] + [(99, None), (98, [1.0])]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    queries = df.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.dist(a, [0] * 4) * math.dist(b, [0] * 4)) or 1)
    got: dict = {}
    for r in batch_top_k(queries, df, 3, block=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
    vectors = {i: v for i, v in data if v is not None and len(v) == 4}
    for q in [i for i in vectors if i % 7 == 0]:
        best = sorted(vectors, key=lambda i: (-round(cos(vectors[q], vectors[i]), 9), i))[:3]
        assert [round(s, 6) for _, _, s in sorted(got[q])] == [round(cos(vectors[q], vectors[i]), 6) for i in best]
