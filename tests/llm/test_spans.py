from __future__ import annotations

import random

from corpusloom.llm.spans import SharedSpans, chains, edits, passages

DDL = "id string, heading string, text string, ingested_at timestamp_ntz, rid long, pos int, context string"


def brute(texts: dict[str, str], n: int) -> set:
    owner: dict = {}
    for i, t in texts.items():
        for k in range(len(t) - n + 1):
            s = t[k : k + n]
            owner[s] = i if owner.get(s, i) == i else None
    out = set()
    for i, t in texts.items():
        run = None
        for k in range(len(t) - n + 1):
            if owner[t[k : k + n]] is None:
                if run and k <= run[1]:
                    run[1] = k + n
                else:
                    if run:
                        out.add((i, *run))
                    run = [k, k + n]
        if run:
            out.add((i, *run))
    return out


def _random_texts(seed: int, letters: str) -> dict[str, str]:
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = [noise(rnd.randrange(20, 90)) for _ in range(6)]
    out = {}
    for i in range(40):
        out[f"n{i}"] = "".join(noise(rnd.randrange(0, 30)) + (s[rnd.randrange(5) :] if rnd.random() < 0.6 else s) for s in rnd.sample(shared, rnd.randrange(0, 4)))
    out |= {"same1": out["n3"], "same2": out["n3"], "loop": "ab" * 100, "loop2": "x" + "ab" * 60, "short": "a", "empty": ""}
    return out


def test_spans_equal_brute_force(spark):
    for seed, letters, fan in ((1, "abcdefgh é\U0001f600", 64), (2, "ab", 64), (3, "abc", 1)):  # fan 1: nearly all by window hashes
        texts = _random_texts(seed, letters)
        df = spark.createDataFrame([(i, None, t, None, 1, 2, "clash") for i, t in texts.items()], DDL)
        got = SharedSpans(df, length=40, k=15, fan=fan).spans().collect()
        assert {tuple(r) for r in got} == brute(texts, 40) and len(got) == len({tuple(r) for r in got})


def test_dirty_rows(spark, rows):
    import datetime as dt

    long = "The pump in hall two was replaced on Monday. " * 6
    data = [
        ("a", "H", long, dt.datetime(2026, 1, 1), 1, 2, ""), ("a", None, long, dt.datetime(2026, 2, 1), 1, 2, ""), ("a", "H", long, dt.datetime(2026, 1, 1), 1, 2, ""),
        ("b", None, None, None, 1, 2, ""), (None, "H", long, None, 1, 2, ""), ("c", "", "q" + long, None, 1, 2, ""),
    ]
    op = SharedSpans(spark.createDataFrame(data, DDL))
    assert rows(op.spans()) == [("a", 0, 270), ("c", 1, 271)]
    assert rows(op.report()) == [("a", 270, 270, 1), ("b", 0, 0, 0), ("c", 271, 270, 1)]
    empty = SharedSpans(spark.createDataFrame([], DDL))
    assert empty.spans().count() == 0 and empty.report().count() == 0


def test_chains_use_every_match_once_and_prefer_order():
    matches = [(0, 100), (50, 150), (100, 200), (60, 10), (50, 150)]
    got = chains(matches, 20)
    assert sorted(m for c in got for m in c) == sorted(set(matches))
    assert got[0] == [(0, 100), (50, 150), (100, 200)]
    assert chains([(0, 0), (1000, 1000)], 20) == [[(0, 0)], [(1000, 1000)]]  # the gap costs more than a match is worth


def test_fuzzy_passages():
    a = "x" * 5 + "the crew measures the shared signal near the relay pump" + "y" * 9
    b = "the crew measures the shored signal near the relay pump"
    i = a.index("the crew")
    found = list(passages(a, b, [(i, 0), (i + 35, 35)], 10))
    assert found[0][:5] == (i, i + len(b), 0, len(b), 1)
    assert edits("kitten", "sitting") == 3 and edits("", "ab") == 2


def test_passages_do_not_depend_on_fan(spark):
    texts = _random_texts(1, "abcdefgh é\U0001f600")
    df = spark.createDataFrame([(i, None, t, None, 1, 2, "clash") for i, t in texts.items()], DDL)
    few, many = (SharedSpans(df, length=40, k=15, fan=fan) for fan in (1, 1000))
    found = {tuple(r)[:7] for r in few.passages().collect()}
    assert found and found == {tuple(r)[:7] for r in many.passages().collect()}


def test_a_stretch_in_more_surroundings_than_fan_keeps_its_passages(spark):
    rnd = random.Random(3)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line = noise(38)
    texts = {f"n{i:02}": noise(60) + line + noise(60) for i in range(70)}
    df = spark.createDataFrame([(i, None, t, None, 1, 2, "clash") for i, t in texts.items()], DDL)
    op = SharedSpans(df, length=40, k=15)
    assert op.classes.where("contexts > 64").count()
    pairs = {(r["id_a"], r["id_b"]) for r in op.passages().collect()}
    seeds: dict = {}
    for r in op.members().collect():
        assert texts[r["id"]][r["first"] : r["first"] + r["chars"]].count(texts[r["id"]][r["pos"] : r["pos"] + 15])
        seeds.setdefault(r["seed"], set()).add(r["id"])
    assert max(map(len, seeds.values())) > 64
    for ids in seeds.values():
        assert {frozenset((a, b)) for a in ids for b in ids if a < b} <= {frozenset(p) for p in pairs}


def test_members_hold_every_link(spark):
    texts = _random_texts(2, "ab")
    df = spark.createDataFrame([(i, None, t, None, 1, 2, "clash") for i, t in texts.items()], DDL)
    seeds: dict = {}
    for r in SharedSpans(df, length=40, k=15).members().collect():
        seeds.setdefault(r["id"], set()).add(r["seed"])
    pieces = {i: {t[k : k + 40] for k in range(len(t) - 39)} for i, t in texts.items()}
    linked = [(a, b) for a in texts for b in texts if a < b and pieces[a] & pieces[b]]
    assert len(linked) > 50 and all(seeds[a] & seeds[b] for a, b in linked)
