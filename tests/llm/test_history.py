from __future__ import annotations

import hashlib
import random
import re

from corpusloom.llm import history
from corpusloom.llm.history import HistoryIndex, first_come, refused_files

FILES = "file_no long, rel string, content binary, batch_no int, received_at timestamp_ntz, n int, token string"
MANIFEST = "file_no long, rel string, sha256 string, chunks int, kept array<int>, spanh string, text_key long"


def text_of(content):
    try:
        t = bytes(content).decode().replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None
    return t if t.strip() else None


def shingles(t):
    w = re.findall("[a-z0-9]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(files, manifest):
    held, out = {}, set()
    shas: dict = {}
    rows = {f[0]: (f[3], text_of(f[2])) for f in files if None not in (f[0], f[2], f[3])}
    present = {f[0] for f in files}
    listed = {m[0] for m in manifest}
    rows = {n: (min(b, 0) if n in listed else b, t) for n, (b, t) in rows.items() if t is not None}

    def accept(n, t):
        held[n] = shingles(t)
        shas.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(n)

    for n, (b, t) in rows.items():
        if b <= 0:
            accept(n, t)
    for m in manifest:
        if m[0] not in present and m[2]:
            shas.setdefault(m[2].strip().lower(), []).append(m[0])
    for n in sorted((n for n in rows if rows[n][0] > 0), key=lambda n: (rows[n][0], n)):
        t = rows[n][1]
        mine = shingles(t)
        met = set(shas.get(hashlib.sha256(t.encode()).hexdigest(), []))
        met |= {o for o, s in held.items() if s and mine and 10 * len(s & mine) >= 7 * len(s | mine)}
        if met:
            out |= {(n, o) for o in met}
        else:
            accept(n, t)
    return out


def test_refusals_equal_the_rules_taken_in_order(spark):
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(90)}" for _ in range(25)] for _ in range(6)]

    def note():
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(25)] = f"w{rnd.randrange(90)}"
        return " ".join(words).encode()

    files = [(n, f"f{n}.md", bytearray(note()), rnd.randrange(0, 4), None, 1, "x") for n in range(1, 91)]
    files += [(200 + i, "short", bytearray(t), b, None, 1, "x") for i, (t, b) in enumerate([(b"hi", 0), (b"hi", 1), (b"yo", 2), (b"yo", 2), (b"\xff", 1), (b" \n", 1), (b"y\r\nz", 1), (b"y\nz", 3)])]
    files += [files[3], (None, "n", bytearray(b"hi"), 1, None, 1, "x"), (300, "n", None, 1, None, 1, "x"), (301, "n", bytearray(b"hi"), None, None, 1, "x")]
    only = hashlib.sha256(files[60][2]).hexdigest()
    manifest = [(500, "m", f" {only.upper()} \n", 1, None, None, 1), (501, "m", None, 1, None, None, 1), (files[5][0], "m", "00", 1, None, None, 1), (500, "m", only, 1, None, None, 1)]
    got = refused_files(spark.createDataFrame(files, FILES), spark.createDataFrame(manifest, MANIFEST)).collect()
    assert {tuple(r) for r in got} == brute(files, manifest) and len(got) == len({tuple(r) for r in got})
    history.HOT = 3  # the ways for large batches: tokens dealt out, edges settled in rounds
    try:
        large = refused_files(spark.createDataFrame(files, FILES), spark.createDataFrame(manifest, MANIFEST), small=0).collect()
    finally:
        history.HOT = 10_000
    assert {tuple(r) for r in large} == brute(files, manifest)


def test_compaction_changes_nothing(spark, rows):
    texts = spark.createDataFrame([(f"sha{i}", i, 2, [i, 7], [i, 7]) for i in range(6)], "sha string, node long, n int, shingles array<long>, prefix array<long>")
    index = HistoryIndex(spark)
    for i in range(6):
        index.append(texts.where(f"node = {i}"))
    before = {k: rows(index.table(k)) for k in ("postings", "sets", "holders")}
    index.compact()
    assert before == {k: rows(HistoryIndex(spark, index.path).table(k)) for k in before} and len(before["postings"]) == 12


def test_empty_tables(spark):
    files, manifest = spark.createDataFrame([], FILES), spark.createDataFrame([], MANIFEST)
    assert refused_files(files, manifest).count() == 0


def test_first_come(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (6, 7), (4, 7)]
    refused: set = set()
    for n in range(1, 8):
        if any(a not in refused for a, b in edges if b == n):
            refused.add(n)
    got = {r[0] for r in first_come(spark.createDataFrame(edges, "lo long, hi long")).collect()}
    assert got == refused
