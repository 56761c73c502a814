from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from corpusloom.llm import neardup
from corpusloom.llm.components import components
from corpusloom.llm.neardup import KIND, NearDuplicates, parity
from corpusloom.llm.prefixes import Common, prefix_length

DDL = "id string, heading string, text string, ingested_at timestamp_ntz, `set` long, words string"


def shingles(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def brute(records: dict[str, str]):
    sets = {i: s for i, t in records.items() if (s := shingles(t))}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


def _family(seed, n=90, vocabulary=60):
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % vocabulary}"
    base = [[word() for _ in range(rnd.randrange(15, 60))] for _ in range(8)]
    out = {}
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 7)):
            words[rnd.randrange(len(words))] = word()
        if rnd.random() < 0.2:
            words = words[rnd.randrange(5) :] + words[:3]
        out[f"r{i}"] = " ".join(words)
    return out


def test_pairs_equal_brute_force(spark, monkeypatch):
    for seed, split in ((1, 20_000), (2, 3)):  # split 3: common shingles go to several reducers
        monkeypatch.setattr(neardup, "SPLIT", split)
        records = _family(seed)
        df = spark.createDataFrame([(i, None, t, None, 5, "clash") for i, t in records.items()], DDL)
        got = [tuple(r) for r in NearDuplicates(df).pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == brute(records)


def test_shingles_that_no_table_knows_are_split_where_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 3)
    records = _family(5)
    df = spark.createDataFrame([(i, None, t, None, 5, "clash") for i, t in records.items()], DDL)
    got = [tuple(r) for r in NearDuplicates(df, common=0).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records)


def test_groups_and_dirty_rows(spark, rows):
    import datetime as dt

    t = " ".join(f"word{i}" for i in range(30))
    data = [
        ("a", "Head", t, dt.datetime(2026, 1, 1), 1, ""), ("a", None, t, dt.datetime(2026, 2, 1), 1, ""), ("b", "Head", t, None, 1, ""), ("c", "Head", t + " more", None, 1, ""),
        ("d", None, "too short", None, 1, ""), ("e", None, None, None, 1, ""), (None, "Head", t, None, 1, ""), ("f", "", "; ".join(["again"] * 50), None, 1, ""), ("g", None, "again " * 70, None, 1, ""),
        ("h", "Lone", " ".join(f"other{i}" for i in range(30)), None, 1, ""),
    ]
    op = NearDuplicates(spark.createDataFrame(data, DDL))
    assert rows(op.pairs()) == [("a", "b"), ("a", "c"), ("b", "c"), ("f", "g")]
    groups = {r["id"]: r for r in op.groups().collect()}
    assert groups["a"]["group_id"] == groups["b"]["group_id"] == groups["c"]["group_id"] != groups["h"]["group_id"]
    assert {i: (r["copies"], r["links"]) for i, r in groups.items()} == {"a": (1, 2), "b": (1, 2), "c": (0, 2), "f": (1, 1), "g": (1, 1), "h": (0, 0)}
    empty = NearDuplicates(spark.createDataFrame([], DDL))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_large_classes_are_dealt_out(spark):
    t = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(f"c{i:03d}", None, t, None, 1, "") for i in range(50)], DDL)
    got = [tuple(r) for r in NearDuplicates(df)._copies(block=7).collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2 and all(a < b for a, b in got)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_prefixes_and_sketch():
    l, p = prefix_length(100, KIND, np.zeros(100, np.int64))
    assert p == 100 - 60 + l
    assert prefix_length(100, KIND, np.full(100, 5000))[0] > prefix_length(5, KIND, np.zeros(5, np.int64))[0]
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rnd.integers(0, 400, 80).astype(np.uint64)) for _ in range(2))
        assert np.bitwise_count(parity(a) ^ parity(b)).sum() <= len(np.setxor1d(a, b))


def test_a_posting_has_the_same_size_at_any_number_of_buckets():
    rnd = random.Random(3)
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{rnd.randrange(9999)}" for _ in range(100)) for _ in range(3000)])], names=["words"])
    none = Common(np.empty(0, np.uint64), np.empty(0, np.int64))

    def written(buckets):
        """Bytes as a shuffle writes them: by bucket, compressed."""
        by = {}
        for b in neardup._postings(KIND, none, buckets, 20_000)([texts]):
            by.setdefault(b.column(0)[0].as_py(), []).append(b.column(1)[0].as_py())
        return sum(len(pa.compress(x, codec="lz4_raw", asbytes=True)) for x in map(b"".join, by.values()))

    assert written(256) < 1.15 * written(8)


def test_postings_are_read_as_they_were_packed():
    rnd = np.random.default_rng(2)
    p = np.zeros(5000, neardup.POSTING)
    for c in ("token", "set"):
        p[c] = rnd.integers(0, 1 << 63, len(p), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    p["n"], p["l"], p["side"] = rnd.integers(1, 600, len(p)), rnd.integers(1, 17, len(p)), rnd.choice([0, 1, neardup.WHOLE], len(p))
    p["n"][:3] = 70_000, 1 << 24, 1
    p["bits"] = rnd.integers(1, 1 << 63, (len(p), 3), dtype=np.uint64)
    with_bits = neardup.sketched(p["n"].astype(np.int64), KIND)
    assert 0 < with_bits.sum() < len(p)
    got = np.concatenate([neardup._unpacked(x, KIND) for _, x in neardup._blobs(p, 7, KIND)])
    p["token"] &= np.uint64((1 << 8 * neardup.TOKEN_BYTES) - 1)
    p["bits"][~with_bits] = 0
    assert sorted(x.tobytes() for x in got) == sorted(x.tobytes() for x in p)
    assert len(neardup._unpacked(next(neardup._blobs(p[~with_bits][:1], 1, KIND))[1], KIND)) == 1


def test_long_records_are_found_with_and_without_a_sketch(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(500)}" for _ in range(460)]
    records = {f"b{i}": " ".join(base[:k]) for i, k in enumerate((250, 290, 298, 302, 303, 320, 400, 460))}
    for i in range(12):
        words = list(base[: rnd.randrange(260, 460)])
        for _ in range(rnd.randrange(40)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(500)}"
        records[f"e{i}"] = " ".join(words)
    df = spark.createDataFrame([(i, None, t, None, 5, "clash") for i, t in records.items()], DDL)
    got = [tuple(r) for r in NearDuplicates(df).pairs().collect()]
    want = brute(records)
    sizes = {i: len(shingles(t)) for i, t in records.items()}
    assert any(sizes[a] < 300 <= sizes[b] or sizes[b] < 300 <= sizes[a] for a, b in want)
    assert len(got) == len(set(got)) and set(got) == want
