"""Problem 8: keyword-stuffed and link-list pages, by the shape of their rank-frequency curves.

Three statistics are made of the word counts of a page's body (without code, tables, logs, headings and front matter): the
slope of log frequency on log rank, fitted over all ranks, the residual of that fit, and the divergence of its most
common words from prose. SQL windows rank and fit the curves. Each page is held against the prose of its language at its
length, that is the pages of the same language and length class that agree with prose: a page is suspect if it diverges
far (DIVERGENT), or if it diverges (SUSPICIOUS) and its curve is steeper than theirs or fits worse (STEEP, ROUGH, in
quartile distances). Nothing else makes a page a case.

An exact check follows, as a case is defined by characters: a suspect is reported if it has at least 200 characters other
than white space and more than half of them are in lists. A block is a run of lines between blank lines, and counts as
list if it diverges from prose as a whole, or consists of links; else those stretches count that do.

Prose is described by its head: the HEAD words of a language with the greatest mean share of a page, measured on all
pages with that label. Copies of a text together count as one page, and words are ranked without the TRIM of pages in
which each is most common, so that many pages of one list, copies or nearly, put no word of theirs into the head. A text's agreement is the share of its words that are head words, each counted at most as often
as about twice its usual share, over the usual share of all of them: about 1 for prose, near 0 for bare keywords, also
where one head word is repeated in every phrase. Of the languages the best one counts, as labels may be wrong. Words are
runs of letters; Han and kana characters are words of their own; within a block, and for the prose heads, link targets and tags are not read as words.

Defined results: null and blank texts are never reported. Labels are compared in lower case without blanks; null and
'und' describe no language. A language with fewer than MIN_PAGES different pages of 20 words or more has no head; pages with
such a label, if they agree with no other language (FOREIGN), may be prose of a language not known here: on them only
lists of links and hashtags are found. Length classes with fewer than CLASS pages of prose in a language are those of all
languages. Several rows with one doc_id are pages of their own and the
doc_id is reported once; rows without doc_id are left out. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizes import by_size, only
from ..scratch import staged

HEAD, MIN_PAGES = 22, 5
#: Chosen by looking at pages of sf0.1: prose has a relative agreement of 0.44 and more, lists of up to 0.51 there.
DIVERGENT, SUSPICIOUS, STEEP, ROUGH = 0.5, 0.75, 1.5, 3.0
FOREIGN, CLASS = 0.2, 10
TRIM = 0.4
LEAST_CHARS, LIST_SHARE = 200, 0.5
AGREEMENT, SWITCH, LANGUAGES_MIXED = 0.35, 1.5, 4

WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W\d_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
ASCII_WORD = re.compile(r"[a-z]+")
URL = re.compile(r"(?:https?|ftp)://[^\s<>()\"'\]]+|\bwww\.[^\s<>()\"'\]]+")
TAG = re.compile(r"<[^<>]++>")
LINK = re.compile(r"!?\[[^\[\]\n]*+\]\([^()\s]++\)|\[\[[^\[\]\n]++\]\]|<a\b[^<>]*+>[^<\n]*+(?:<(?!/?a\b)[^<\n]*+)*+</a>|(?:https?|ftp)://[^\s<>()\"'\]]+", re.I)
TARGET = re.compile(r"\]\([^()\s]++\)")
HASHTAG = re.compile(r"(?<!\S)#[^\s#]+")
FRONT = re.compile(r"\A\ufeff?---\n.*?\n---(?:\n|\Z)", re.S)
FENCE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)", re.S | re.M)
BLANK_LINE = re.compile(r"\n\s*\n")
HEADING = re.compile(r"\s{0,3}#{1,6}\s+\S")
TABLE = re.compile(r"\s*\|.*\|\s*$")
LOG = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d|\d\d:\d\d)\S*(?:[ T]\d\d:\d\d\S*)?\]?\s+\[?(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b")
CODE = re.compile(r"(?: {4}|\t)\S")
#: Lines of a body that are neither prose nor list: each of the patterns above at the start of a line.
OTHER = re.compile("|".join(rf"^(?:{p})" for p in (HEADING.pattern.replace(r"\s", "[ \\t]") + ".*$", r"[ \t]*\|.*\|[ \t]*$", LOG.pattern.replace(r"\s*", r"[ \t]*", 1) + ".*$", CODE.pattern + ".*$")), re.M)


def words_of(lowered: str) -> list[str]:
    return (ASCII_WORD if lowered.isascii() else WORD).findall(lowered)


def page_words(text: str) -> list[str]:
    text = text.lower()
    if "](" in text:
        text = TARGET.sub("] ", text)
    if "://" in text or "www." in text:
        text = URL.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    return words_of(text)


def body_of(text: str) -> str:
    """A page without front matter, code, tables, logs and headings."""
    return OTHER.sub("", FENCE.sub("\n\n", FRONT.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))))


def dark(text: str) -> int:
    """Characters other than white space."""
    return len("".join(text.split()))


def _label(lang: str | None) -> str:
    lang = (lang or "").strip().lower()
    return "" if lang == "und" else lang


FLUSH = 300_000


def _shares(batches):
    """Per language, word and level the pages and the sum of the word's shares of them, each page by its weight; a level is
    a power of two of the share. What a task has counted is given out whenever it has FLUSH cells."""
    pages: Counter = Counter()
    cells: dict[str, dict[tuple[str, int], list[float]]] = {}
    kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]

    def flushed():
        rows = [(lang, "", 0, float(n), 0.0) for lang, n in pages.items()]
        rows += [(lang, w, level, seen, share) for lang, mine in cells.items() for (w, level), (seen, share) in mine.items()]
        pages.clear()
        cells.clear()
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["lang", "word", "level", "seen", "share"])

    for b in batches:
        for text, lang, weight in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "weight"))):
            lang = _label(lang)
            words = page_words(text) if lang else []
            if len(words) >= 20:
                pages[lang] += weight
                mine, size = cells.setdefault(lang, {}), len(words)
                for w, n in Counter(words).items():
                    cell = mine.setdefault((w, (size // n).bit_length()), [0.0, 0.0])
                    cell[0] += weight
                    cell[1] += weight * n / size
        if sum(map(len, cells.values())) > FLUSH:
            yield flushed()
    yield flushed()


def _weighted(documents: DataFrame) -> DataFrame:
    """(text, lang, weight): all copies of a text under one label together weigh as one page. No text is moved for it
    unless more texts have copies than are broadcast."""
    rows = documents.where("text is not null").select("text", "lang", F.xxhash64(F.lower(F.trim("lang")), "text").alias("copy"))
    copies = staged(rows.groupBy("copy").agg(F.count("*").alias("copies")).where("copies > 1"), "page-copies")
    return rows.join(by_size(copies), "copy", "left").select("text", "lang", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))


def prose_heads(documents: DataFrame) -> dict[str, dict[str, float]]:
    """The head words of each language with their mean shares; HEAD rows for each label with MIN_PAGES pages are collected."""
    rows = _weighted(documents).mapInArrow(_shares, "lang string, word string, level int, seen double, share double")
    summed = staged(rows.groupBy("lang", "word", "level").agg(F.sum("seen").alias("seen"), F.sum("share").alias("share")), "word-shares")
    pages = summed.where("word = ''").select("lang", F.round("seen", 6).alias("pages")).where(F.col("pages") >= MIN_PAGES)
    # Of each word the TRIM of all pages in which it is most common is cut off, from the highest level downwards.
    before = F.coalesce(F.sum("seen").over(Window.partitionBy("lang", "word").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = F.least(F.col("seen"), F.greatest(before + F.col("seen") - F.col("pages") * TRIM, F.lit(0.0)))
    words = summed.where("word <> ''").join(by_size(staged(pages, "languages")), "lang").withColumn("kept", kept)
    words = words.groupBy("lang", "word", "pages").agg(F.sum("share").alias("share"), F.round(F.sum(F.col("share") * F.col("kept") / F.col("seen")), 6).alias("usual"))
    ranked = words.where("usual > 0").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("usual"), "word")))
    heads: dict[str, dict[str, float]] = {}
    for lang, word, share, n in ranked.where(F.col("rank") <= HEAD).select("lang", "word", "share", "pages").collect():
        heads.setdefault(lang, {})[word] = share / n
    return heads


def agreement(count: Counter, n: int, heads: dict[str, dict[str, float]]) -> tuple[float, str]:
    """How far word counts agree with the prose of the language they agree with most, and which it is."""
    index, usual = _by_word(heads)
    got: dict[str, float] = {}
    for w in count if len(count) < len(index) else index:
        if w in count:
            for lang, share in index.get(w, ()):
                got[lang] = got.get(lang, 0.0) + min(count[w], max(2 * share * n, 2))
    return max(((x / n / usual[lang], lang) for lang, x in got.items()), default=(0.0, ""))


_words: list = [None, None]


def _by_word(heads: dict[str, dict[str, float]]) -> tuple[dict[str, list[tuple[str, float]]], dict[str, float]]:
    """The languages in whose head each word is, and the sum of each head's shares; made once for the heads last used."""
    if _words[0] is not heads:
        index: dict[str, list[tuple[str, float]]] = {}
        for lang, head in heads.items():
            for w, share in head.items():
                index.setdefault(w, []).append((lang, share))
        _words[:] = [heads, (index, {lang: sum(head.values()) for lang, head in heads.items()})]
    return _words[1]


def _list_part(block: str, size: int, heads: dict[str, dict[str, float]]) -> int:
    """Characters of a block in stretches of list: all of it if it diverges as a whole, else those of the runs of words
    whose agreement is so far below AGREEMENT that a change of kind at both ends is more likely than chance (SWITCH)."""
    words = page_words(block)
    if not words:
        return 0
    count, n = Counter(words), len(words)
    if agreement(count, n, heads)[0] < AGREEMENT:
        return size
    masked = block.lower()
    for pattern in (TARGET, URL, TAG):
        masked = pattern.sub(lambda m: "/" * len(m[0]), masked)
    # A block may be prose of several languages; those it agrees with at all, LANGUAGES_MIXED at most.
    alone = lambda h: sum(min(count[w], max(2 * share * n, 2)) for w, share in h.items() if w in count) / n / sum(h.values())
    fits = sorted(((alone(h), x) for x, h in heads.items()), reverse=True)[:LANGUAGES_MIXED]
    spoken = [(heads[x], AGREEMENT * sum(heads[x].values())) for fit, x in fits if fit > 0]
    places = list((ASCII_WORD if masked.isascii() else WORD).finditer(masked))
    # The best division into list (state 0) and prose of each language, which gains 1 by a head word and loses by each word.
    score, back = [-SWITCH] + [0.0] * len(spoken), []
    for m in places:
        w = m[0]
        best = max(score)
        top, change = score.index(best), best - SWITCH
        back.append([i if x >= change else top for i, x in enumerate(score)])
        score = [max(x, change) for x in score]
        for i, (head, loss) in enumerate(spoken, 1):
            score[i] += (min(1.0, max(2 * head[w] * n, 2) / max(count[w], 1)) if w in head else 0.0) - loss
    state, total = score.index(max(score)), 0
    for i in range(len(places) - 1, -1, -1):
        if state == 0:
            total += dark(masked[places[i].start() if i else 0 : places[i + 1].start() if i + 1 < len(places) else len(masked)])
        state = back[i][state]
    return min(total, size)


def list_chars(text: str, heads: dict[str, dict[str, float]]) -> int:
    """Characters, other than white space, that stand in lists of keywords, phrases, tags, products or links.

    With no heads only links and hashtags are found.
    """
    text = FENCE.sub("\n\n", FRONT.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    total = 0
    for block in BLANK_LINE.split(text):
        lines = [x for x in block.split("\n") if x.strip() and not (HEADING.match(x) or TABLE.match(x) or LOG.match(x))]
        if all(CODE.match(x) for x in lines):
            continue
        block = "\n".join(lines)
        size = dark(block)
        marked = sum(dark(m[0]) for m in LINK.finditer(block)) + sum(len(m[0]) for m in HASHTAG.finditer(block))
        if marked >= 0.7 * size:
            total += size
        elif heads:
            total += _list_part(block, size, heads)
    return total


#: curve: how many words (m) occur n times.
_PAGE = "page long, doc_id long, lang string, words long, chars long, agreement double, curve array<struct<n: long, m: long>>"


def _measure(heads: dict[str, dict[str, float]]):
    point = pa.list_(pa.struct([("n", pa.int64()), ("m", pa.int64())]))

    def run(batches):
        for b in batches:
            out = []
            for page, doc, text in zip(*(b.column(c).to_pylist() for c in ("page", "doc_id", "text"))):
                words = words_of(body_of(text).lower())  # link targets too: a page of links is no prose
                count = Counter(words)
                curve = [{"n": n, "m": m} for n, m in Counter(count.values()).items()]
                fit, best = agreement(count, len(words), heads) if words else (0.0, "")
                out.append((page, doc, best, len(words), dark(text), fit, curve))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), point]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _PAGE.split(", ", 6)])

    return run


def _rows(documents: DataFrame) -> DataFrame:
    rows = documents.where("text is not null and doc_id is not null")
    return rows.select(F.xxhash64("doc_id", "text", "lang").alias("page"), "doc_id", "text", "lang")


def page_curves(documents: DataFrame, heads: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(page, doc_id, lang, words, chars, agreement, slope, residual) of every page with a text.

    slope and residual are those of the line fitted to log frequency on log rank, over all ranks; null for fewer than three
    words. Words that occur equally often have consecutive ranks: a window gives the first, and their logs are added up.
    """
    heads = prose_heads(documents) if heads is None else heads
    pages = staged(_rows(documents).select("page", "doc_id", "text").mapInArrow(_measure(heads), _PAGE), "page-curves")
    w = Window.partitionBy("page")
    runs = pages.groupBy("page").agg(F.first("curve").alias("curve")).select("page", F.explode("curve").alias("p")).select("page", "p.n", "p.m")
    last = F.sum("m").over(w.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"))
    logs = F.aggregate(F.sequence(F.col("last") - F.col("m") + 1, F.col("last")), zero, lambda s, r: F.struct((s["x"] + F.log(r)).alias("x"), (s["xx"] + F.log(r) * F.log(r)).alias("xx")))
    runs = runs.withColumn("last", last).select("page", F.col("m").cast("double").alias("m"), F.log(F.col("n")).alias("y"), logs.alias("x"))
    total = lambda c: F.sum(c).over(w)
    sums = runs.select(
        "page", total("m").alias("k"), total("x.x").alias("x"), total("x.xx").alias("xx"), total(F.col("m") * F.col("y")).alias("y"),
        total(F.col("x.x") * F.col("y")).alias("xy"), total(F.col("m") * F.col("y") * F.col("y")).alias("yy"),
    ).dropDuplicates(["page"]).where("k >= 3")
    var, cov, dev = (F.col(a) / F.col("k") - F.col(b) * F.col(c) / F.col("k") / F.col("k") for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    fitted = sums.select("page", (cov / var).alias("slope"), F.sqrt(F.greatest(dev - cov * cov / var, F.lit(0.0))).alias("residual"))
    return pages.drop("curve").join(fitted, "page", "left")


def suspects(curves: DataFrame) -> DataFrame:
    """curves -> with `relative`, `steeper` and `rougher`, and `suspect` if these are out of line.

    The line is that of prose: of the pages whose agreement is 0.8 or more, equal curves once, in a language and length
    class (powers of two). relative is the agreement over its median there (over 1, where that is less); steeper and
    rougher say by how many quartile distances slope and residual are off. Without prose of that length these are null.
    """
    length = F.floor(F.log2(F.greatest(F.col("words"), F.lit(1))))
    curves = staged(curves.withColumn("length", length), "curves")
    prose = curves.where("agreement >= 0.8").select("lang", "length", "words", "slope", "residual", "agreement").distinct()
    q = F.lit([0.25, 0.5, 0.75])
    line = lambda by: staged(
        prose.groupBy(*by).agg(
            F.percentile_approx("slope", q, 1000).alias("s"), F.percentile_approx("residual", q, 1000).alias("r"), F.percentile_approx("agreement", 0.5, 1000).alias("a"), F.count("*").alias("of"),
        ).where(F.col("of") >= (CLASS if len(by) > 1 else 1)),
        "prose-lines",
    )
    own = line(["lang", "length"]).select("lang", "length", F.struct("s", "r", "a").alias("own"))
    every = line(["length"]).select("length", F.struct("s", "r", "a").alias("every"))
    out = curves.join(by_size(own), ["lang", "length"], "left").join(by_size(every), "length", "left").withColumn("line", F.coalesce("own", "every"))

    def off(c: str, of: str, least: float):
        return (F.col(c) - F.col(of)[1]) / F.greatest(F.col(of)[2] - F.col(of)[0], F.lit(least))

    out = out.withColumn("relative", F.col("agreement") / F.greatest(F.coalesce("line.a", F.lit(1.0)), F.lit(1.0)))
    out = out.withColumn("steeper", -off("slope", "line.s", 0.05)).withColumn("rougher", off("residual", "line.r", 0.02))
    bent = F.coalesce((F.col("steeper") >= STEEP) | (F.col("rougher") >= ROUGH), F.lit(False))
    return out.withColumn("suspect", (F.col("relative") < DIVERGENT) | ((F.col("relative") < SUSPICIOUS) & bent)).drop("own", "every", "line")


def measured(documents: DataFrame, pages: DataFrame, heads: dict[str, dict[str, float]]) -> DataFrame:
    """(page, doc_id, chars, list_chars) of the given pages (a staged table with their key)."""

    def run(batches):
        for b in batches:
            got = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                words = page_words(text) if _label(lang) and _label(lang) not in heads else []
                foreign = bool(words) and agreement(Counter(words), len(words), heads)[0] < FOREIGN
                got.append(list_chars(text, {} if foreign else heads))
            chars = [dark(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page"), b.column("doc_id"), pa.array(chars, pa.int64()), pa.array(got, pa.int64())], names=["page", "doc_id", "chars", "list_chars"])

    return only(_rows(documents), pages, "page").mapInArrow(run, "page long, doc_id long, chars long, list_chars long")


def list_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the keyword-stuffed and link-list pages."""
    heads = prose_heads(documents)
    found = suspects(page_curves(documents, heads)).where(F.col("suspect") & (F.col("chars") >= LEAST_CHARS))
    seen = measured(documents, staged(found.select("page").distinct(), "suspect-pages"), heads)
    return seen.where(F.col("list_chars") > LIST_SHARE * F.col("chars")).select("doc_id").distinct()
