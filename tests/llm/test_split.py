from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.split import split, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!\n 。\U0001f600", max_size=300), st.integers(1, 60), st.integers(0, 59))
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = split(text, limit, overlap)
    edges = [0, *[m.end() for m in re.finditer(r"\n|。|[.!?](?=\s)", text)], len(text)]
    end = 0
    for n, (s, e, kind, had_to) in enumerate(pieces):
        assert e - s <= limit and s == (max(0, end - overlap) if n else 0) and (e > end or not text)
        if n < len(pieces) - 1:
            assert (kind > 0) == (e in edges)
        end = e
    assert end == len(text)
    assert any(p[3] for p in pieces) == any(b - a > limit for a, b in zip(edges, edges[1:]))


def test_strongest_boundary_near_the_middle():
    text = "a" * 40 + ".\n\n" + "b" * 10 + ". " + "c" * 40
    assert split(text, 60, 5)[0][1:3] == (43, 3)


def test_table(spark, rows):
    ident = spark.createDataFrame([("hash", 8, "k", 10, 3), ("hash", 8, "k", 12, 3), ("hash", 8, "odd", 5, 9), ("x", 1, "none", None, 1)], "embedder string, embed_dim int, collection string, max_chars int, overlap int")
    data = [("a", "s", "H", 0, "one two. three four. five", "k"), ("a", "s", None, 0, "one two. three four. five", "k"), ("b", "s", None, 1, "short", "k"), ("c", "s", "", 2, None, "k"), ("d", "s", "", 2, "x" * 11, "odd"), ("e", "s", "", 2, "x" * 99, "none"), ("f", "s", "", 2, "x" * 99, None)]
    chunks = spark.createDataFrame(data, "id string, source string, heading string, chunk_index int, text string, collection string")
    got = rows(split_oversized(chunks, ident).select("id", "heading", "chunk_index", "start", "text"))
    assert [r[:4] for r in got if r[0] == "d"] == [("d", "", 0, 0), ("d", "", 1, 5), ("d", "", 2, 8)] or sum(len(r[4]) for r in got if r[0] == "d") == 11
    assert {r[0] for r in got} == {"a", "d"} and {r[1] for r in got if r[0] == "a"} == {"H"}
    assert split_oversized(chunks.limit(0), ident).count() == 0 and split_oversized(chunks, ident.limit(0)).count() == 0
