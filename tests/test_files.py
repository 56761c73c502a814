from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from corpusloom.functions.buckets import blake2b_bucket, sha2_bucket_of
from corpusloom.operators.embed import HashEmbedder
from corpusloom.operators.store import SPAN, ChunkStore
from corpusloom.sources.files import CorpusFiles, corpus_files, write_files

NAMES = ["_x/.y/a.md", "b[1] c%20.MARKDOWN", "e/f/g/h.md", "e/f/i.md", "d.txt", ".md", "e/.hidden.md"]


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_folders_are_written_and_read_whole(spark, tmp_path, prefix):
    root = f"{prefix}{tmp_path}/vault"
    rows = spark.createDataFrame([(n, bytearray(n.encode())) for n in NAMES], "rel string, content binary")
    assert write_files(rows, root) == len(NAMES)
    wanted = {n: n.encode() for n in NAMES if n not in ("d.txt", ".md")}
    assert {r["rel"]: bytes(r["content"]) for r in corpus_files(spark, root).collect()} == wanted
    for slices in ("1", "2"):  # the tasks walk what lies below
        spark.dataSource.register(CorpusFiles)
        read = spark.read.format("corpus_files").option("root", root).option("slices", slices).load()
        assert {r["rel"] for r in read.collect()} == set(wanted)
    with pytest.raises(Exception, match="outside the root"):
        write_files(spark.createDataFrame([("../a.md", bytearray(b""))], "rel string, content binary"), root)


def test_a_long_source_is_spread_over_buckets(spark, rows):
    store = ChunkStore(spark, None, "knowledge", HashEmbedder(8), buckets=16)
    many = [(f"log.md::{i}", "log.md", i, f"entry {i}") for i in range(0, 20 * SPAN, SPAN // 2)]
    store.add(spark.createDataFrame(many, "id string, source string, chunk_index int, text string"))
    assert len(store._state()["buckets"]) > 5 and store.count() == len(many)
    store.delete(spark.createDataFrame([(x[0],) for x in many[1:]], "id string"))
    assert rows(store.table().select("id", "text")) == [("log.md::0", "entry 0")]
    nearest = store.query("entry 0", 3).collect()
    assert [(r["id"], round(r["similarity"], 6)) for r in nearest] == [("log.md::0", 1.0)]


def test_hashed_batches_equal_single_texts():
    texts = ["The pump, the gate", None, "", "été x9 x9 X9", "pump " * 50]
    for e, bucket in ((HashEmbedder(16), blake2b_bucket), (HashEmbedder(16, "hash-sha2", "sha2"), sha2_bucket_of)):
        for t, v in zip(texts, e.vectors(texts)):
            n = Counter(bucket(w, 16) for w in re.findall("[a-z0-9]+", (t or "").lower()))
            length = math.sqrt(sum(x * x for x in n.values())) or 1.0
            assert all(abs(v[b] - n[b] / length) < 1e-12 for b in range(16))
