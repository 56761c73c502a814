from __future__ import annotations

import random

import regex

from corpusloom.llm import leaks
from corpusloom.llm.leaks import LeakSearch

WORD = regex.compile(r"[\p{L}\p{N}]+")
DOCS = "doc_id long, text string, item_id long, pos int"
ITEMS = "item_id long, suite string, text string, doc_id long"


def brute(docs, items):
    out = set()
    for d, t, *_ in docs:
        words = WORD.findall((t or "").lower())
        for i, _, x, _ in items:
            q = WORD.findall((x or "").lower())
            n = min(13, len(q))
            runs = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            if d is not None and i is not None and any(tuple(words[k : k + n]) in runs for k in range(len(words) - n + 1)):
                out.add((d, i))
    return out


def _data(seed):
    rnd = random.Random(seed)
    w = lambda n: [rnd.choice(["alpha", "Beta", "漢", "été", "x9", "the", "the", "of"]) + rnd.choice(["", "", "s"]) for _ in range(n)]
    items = [(i, "s", ", ".join(w(rnd.choice([0, 1, 3, 12, 13, 14, 40]))), 5) for i in range(30)]
    docs = []
    for d in range(60):
        words = w(rnd.randrange(40))
        q = WORD.findall(rnd.choice(items)[2])
        cut = rnd.randrange(len(q) + 1)
        docs.append((d, " ".join(words[:9] + q[cut : cut + rnd.randrange(30)] + words[9:]), 1, 1))
    return docs + [(70, None, 1, 1), (71, "", 1, 1), (None, docs[0][1], 1, 1), docs[1], (72, "the " * 3000, 1, 1)], items + [(None, "s", "alpha", 1), (90, "s", None, 1), (91, "s", "?!", 1), (92, "s", "the " * 20, 1)]


def test_found_equals_brute_force(spark, monkeypatch):
    for seed, block in ((1, 2_000_000), (2, 40)):  # a small block: the items are taken in several
        monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
        docs, items = _data(seed)
        search = LeakSearch(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
        assert block > 1000 or len(search.blocks) > 1
        found = search.exact().collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, items)
        texts, asked = dict((d[0], d[1]) for d in docs), dict((i[0], i[2]) for i in items)
        for r in found[:200]:
            a, b = WORD.findall(texts[r["doc_id"]].lower()), WORD.findall(asked[r["item_id"]].lower())
            assert a[r["pos"] : r["pos"] + r["words"]] == b[r["first"] : r["first"] + r["words"]]


def test_near_finds_edited_passages(spark):
    item = "the overloaded pump near the northern gate stopped twice while nobody watched the amber signal lamp"
    edited = item.replace("twice", "again and again").replace("amber ", "")
    docs = spark.createDataFrame([(1, "Before. " + edited, 0, 0), (2, "pump signal gate lamp", 0, 0), (3, item, 0, 0)], DOCS)
    search = LeakSearch(docs, spark.createDataFrame([(7, "s", item, 0)], ITEMS))
    assert {r["doc_id"] for r in search.exact().collect()} == {3}
    assert {r["doc_id"] for r in search.near(anchors=3).collect()} >= {3} and 2 not in {r["doc_id"] for r in search.near(anchors=3).collect()}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full_docs, full_items = (spark.createDataFrame(x, d) for x, d in zip(_data(1), (DOCS, ITEMS)))
    for d, i in ((docs, items), (full_docs, items), (docs, full_items)):
        search = LeakSearch(d, i)
        assert search.exact().count() == 0 and search.near().count() == 0


def test_near_finds_passages_without_their_rarest_words(spark):
    item = "the overloaded pump near the northern gate stopped twice while nobody watched the amber signal lamp"
    edited = item.replace("twice", "again and again").replace("amber ", "")
    docs = [(1, "Before. " + edited, 0, 0), (2, "pump signal gate lamp", 0, 0), (3, item, 0, 0), (4, "a blue valve turns, then the crew rests", 0, 0)]
    items = [(7, "s", item, 0), (8, "s", "blue valve turns", 0), (9, "s", "then the weary crew rests", 0), (10, "s", "valve rests", 0), (11, "s", "crew", 0), (12, "s", "unheard", 0)]
    for asked in (docs, [d for d in docs if d[0] != 3]):  # without document 3 two words of item 7 occur nowhere
        search = LeakSearch(spark.createDataFrame(asked, DOCS), spark.createDataFrame(items, ITEMS))
        for anchors in (3, 4):
            got = {(r["doc_id"], r["item_id"]) for r in search.near(anchors=anchors).collect()}
            assert got == {(d[0], 7) for d in asked if d[0] in (1, 3)} | {(4, 8), (4, 9), (4, 10), (4, 11)}


def test_near_finds_all_that_is_exact(spark):
    docs, items = _data(4)
    search = LeakSearch(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    exact = {(r["doc_id"], r["item_id"]) for r in search.exact().collect()}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in search.near().collect()}


def test_near_recall_and_precision_on_planted_edits(spark):
    """Half of the documents hold a passage of an item with up to three words changed, dropped or put in."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    word = lambda: vocabulary[min(int(rnd.paretovariate(0.3)), 2999)]
    items = [(i, "s", " ".join(word() for _ in range(rnd.randrange(13, 50))), 0) for i in range(60)]
    docs, planted = [], set()
    for d in range(400):
        words = [word() for _ in range(120)]
        if d % 2:
            i = rnd.randrange(60)
            q = items[i][2].split()
            at = rnd.randrange(len(q) - 12)
            q = q[at : at + 20]
            for _ in range(rnd.randrange(4)):
                k = rnd.randrange(len(q))
                q[k : k + 1] = rnd.choice([[word()], [], [q[k], word()]])
            words[40:40] = q
            planted.add((d, i))
        docs.append((d, " ".join(words), 0, 0))
    got = {(r["doc_id"], r["item_id"]) for r in LeakSearch(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).near().collect()}
    assert len(got & planted) >= 0.95 * len(planted) and len(got & planted) >= 0.8 * len(got), (len(got & planted) / len(planted), len(got & planted) / len(got))
