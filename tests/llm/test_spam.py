from __future__ import annotations

import random

from corpusloom.llm.spam import list_chars, list_pages, page_curves, prose_heads, suspects

DDL = "doc_id long, text string, lang string, source string, page long, slope double"
NOUNS = [f"{a}{b}" for a in ("pump", "gate", "lamp", "crew", "dock", "valve", "shelf", "rotor") for b in ("", "s", "yard", "man", "line")]


def prose(rnd, sentences):
    one = lambda: f"{rnd.choice(['The', 'A', 'Every'])} {rnd.choice(NOUNS)} {rnd.choice(['of the', 'near a', 'for the'])} {rnd.choice(NOUNS)} moves the {rnd.choice(NOUNS)} and it waits."
    return " ".join(one() for _ in range(sentences))


def _pages():
    rnd = random.Random(9)
    phrase = lambda: f"{rnd.choice(['cheap', 'best', 'free'])} {rnd.choice(NOUNS)}"
    good = {i: "\n\n".join(prose(rnd, rnd.randrange(3, 9)) for _ in range(3)) for i in range(120)}
    good[200] = "\n".join(f"- [x] {prose(rnd, 1)}" for _ in range(12))
    good[201] = "\n".join(f"**{rnd.choice(NOUNS)}**: {prose(rnd, 1)}" for _ in range(12))
    good[202] = prose(rnd, 3) + "\n\n" + "\n".join(f"2026-01-02 WARN {rnd.choice(NOUNS)} {rnd.choice(NOUNS)}={i} stops" for i in range(40))
    good[203] = prose(rnd, 2) + "\n\n```\n" + "\n".join(f"{rnd.choice(NOUNS)} = {rnd.choice(NOUNS)}.run({i})" for i in range(60)) + "\n```\n"
    good[204] = "| a | b |\n|---|---|\n" + "\n".join(f"| {rnd.choice(NOUNS)} | {i} |" for i in range(60))
    good[205] = " ".join(f"The [{rnd.choice(NOUNS)}](https://x.example/{i}) of the {rnd.choice(NOUNS)} moves a {rnd.choice(NOUNS)} and it waits near the gate." for i in range(9))
    good[206] = prose(rnd, 9) + "\n\nTags: " + ", ".join(phrase() for _ in range(9))
    good[207] = "free pump, best gate"  # a list, but far too short
    bad = {
        300: ", ".join(phrase() for _ in range(60)), 301: "\n".join(f"- {rnd.choice(NOUNS)} {rnd.choice(NOUNS)}, {i}.99" for i in range(60)),
        302: "\n".join(f"* [{phrase()}](https://shop.example/{i})" for i in range(30)), 303: "\n".join(f"#{rnd.choice(NOUNS)}_{rnd.choice(NOUNS)}" for _ in range(40)),
        304: ". ".join(" ".join(["Pump", rnd.choice(NOUNS), "pump", "pump", "cheap"]) for _ in range(30)) + ".", 305: prose(rnd, 2) + "\n\n" + " | ".join(phrase() for _ in range(90)),
        306: "\n".join(f"https://www.example/{rnd.choice(NOUNS)}/{i}" for i in range(30)), 307: ", ".join(f"{rnd.choice(NOUNS)} in Town{i}" for i in range(60)),
    }
    return good, bad


def test_lists_are_found_and_nothing_else(spark):
    good, bad = _pages()
    rows = [(i, t, random.Random(i).choice(["en", "EN", " en"]), "s", 1, 0.5) for i, t in (good | bad).items()]
    rows += [(400, None, "en", "s", 1, 0.5), (401, "", None, "s", 1, 0.5), (402, " \n", "und", "s", 1, 0.5), (None, bad[300], "en", "s", 1, 0.5), rows[-1], (403, "部品 " * 200, "ja", "s", 1, 0.5)]
    df = spark.createDataFrame(rows, DDL)
    got = [r[0] for r in list_pages(df).collect()]
    assert sorted(got) == sorted(bad)
    assert set(prose_heads(df)) == {"en"}
    curves = {r["doc_id"]: r for r in suspects(page_curves(df)).collect()}
    assert all(curves[i]["suspect"] for i in bad) and curves[5]["slope"] < 0 and 0.7 < curves[5]["agreement"]


def test_empty_table(spark):
    assert list_pages(spark.createDataFrame([], DDL)).count() == 0


def test_line_ends_and_front_matter_do_not_matter():
    head = {"en": {"the": 0.2, "a": 0.1, "of": 0.1}}
    text = "---\ntitle: Pump gate lamp\n---\nthe lamp of a gate\n\npump gate, lamp valve, rotor shelf\n"
    assert list_chars(text, head) == list_chars(text.replace("\n", "\r\n"), head) == len("pumpgate,lampvalve,rotorshelf")
    assert list_chars("", head) == 0


def test_copies_of_a_list_do_not_become_prose(spark):
    good, bad = _pages()
    pages = [(i, t) for i, t in good.items() if i < 120]
    words = "cheap sofa best lease free gantry bulk winch sale hoist".split()
    page = lambda n: ", ".join(f"{words[i % 10]} {words[(i * 3 + 1) % 10]}" for i in range(60)) + f", lot{chr(97 + n % 26)}{chr(97 + n // 26)}"
    for same in (True, False):  # a third of the rows: copies of one list, or lists that differ in a word
        rows = pages + [(1000 + i, page(0 if same else i)) for i in range(60)]
        df = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], DDL)
        assert not set(words) & set(prose_heads(df)["en"])
        assert {r[0] for r in list_pages(df).collect()} == set(range(1000, 1060))


def test_lists_inside_a_block_are_measured(spark):
    rnd = random.Random(5)
    good, _ = _pages()
    keywords = lambda n: ", ".join(f"{rnd.choice(['cheap', 'best', 'free'])} {rnd.choice(NOUNS)}" for _ in range(n))
    rows = [(i, t) for i, t in good.items() if i < 120]
    for i in range(10):  # sentences and then keyword lines without a blank line, and the other way round
        rows += [(500 + i, prose(rnd, 6) + "\n" + keywords(60)), (600 + i, prose(rnd, 12) + "\n" + keywords(30))]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], DDL)
    assert {r[0] for r in list_pages(df).collect()} == set(range(500, 510))
    text = prose(rnd, 9) + "\n" + keywords(60)
    assert abs(list_chars(text, prose_heads(df)) - len("".join(text.split("\n")[1].split()))) < 60


def test_the_partitions_do_not_matter_and_links_may_be_long(spark):
    good, bad = _pages()
    bad[308] = "\n".join(f"* [{' '.join(NOUNS)} {i}](https://shop.example/{'x' * 3000}{i})" for i in range(9))
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in (good | bad).items()], DDL)
    found = [sorted(r[0] for r in list_pages(df.repartition(n)).collect()) for n in (2, 11)]
    assert found[0] == found[1] == sorted(bad)
    heads = [prose_heads(df.repartition(n)) for n in (2, 11)]
    assert {w: round(x, 9) for w, x in heads[0]["en"].items()} == {w: round(x, 9) for w, x in heads[1]["en"].items()}


def test_curves_are_fitted_over_all_ranks(spark):
    import numpy as np

    rnd = random.Random(2)
    text = " ".join(rnd.choice(NOUNS[: int(rnd.paretovariate(0.8)) % 40 + 1]) for _ in range(700))
    (r,) = page_curves(spark.createDataFrame([(1, text, "en", "s", 1, 0.5)] * 2, DDL)).select("slope", "residual").distinct().collect()
    n = sorted((text.split().count(w) for w in set(text.split())), reverse=True)
    x, y = np.log(np.arange(1, len(n) + 1)), np.log(n)
    slope, level = np.polyfit(x, y, 1)
    assert abs(r["slope"] - slope) < 1e-6 and abs(r["residual"] - np.sqrt(np.mean((y - level - slope * x) ** 2))) < 1e-6


def test_pages_of_an_unknown_label_are_measured_if_they_speak_a_known_language(spark):
    good, bad = _pages()
    rows = [(i, t, "en") for i, t in good.items() if i < 120]
    rows += [(500, "\n\n".join([prose(random.Random(1), 3), bad[300]]), "xx"), (501, "kivi talo meri puu lumi tie " * 30, "fi"), (502, bad[302], "fi")]
    df = spark.createDataFrame([(i, t, lang, "s", 1, 0.5) for i, t, lang in rows], DDL)
    assert {r[0] for r in list_pages(df).collect()} == {500, 502}
