"""Problem 1: long spans that records share, found by chaining shared k-mer seeds.

Seeds. In every window of `length` characters the k-mer with the smallest hash is its seed (robust winnowing), so two
equal windows have the same seed at the same offset, and a text has about 2/(length-k) seeds a character. All windows
that share one seed occurrence form its context.

Matches. Occurrences of one seed are classed by context. Members of a class are joined to the class's first record (and
that one to another), a number of matches linear in the occurrences; contexts that stand in one record only are joined
to the other contexts of the seed, however many there are. spans() needs no pairs of contexts: at a seed with more than
`fan` of them (a boilerplate line shorter than `length`, in ever other surroundings) the windows of `length` characters
themselves are the classes, each window matched with the first record that has it, which is exact and linear. A class,
a seed or a first record with more than HOT rows to join is dealt out over several tasks. members() lists the records of each seed and context, so that a link that matches do not name
(two records joined only to the first of their context) can be read from it.

Chains. The matches of two records are chained in order of position: a Fenwick tree over the second record's positions
holds the best score before each, with a gap cost for the distance skipped. Chains are cut from the best downwards until
each match is in one, extended to whole equal blocks, and aligned across short gaps to fuzzy passages. Equal blocks of
at least `length` characters are the exact spans.

Defined results: a null text counts as ''; texts shorter than `length` share nothing; rows of one id are one record
(see record_rows) and share nothing with each other; repetition inside one record does not count. Offsets are code
points. An empty table gives no rows. Columns other than id, heading, text, ingested_at are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.records import record_rows
from ..operators.sizes import only
from ..scratch import staged
from . import kernels as K
from .skew import dealt_join

LENGTH, SEED, FAN, GAP = 200, 100, 64, 64
#: Of a join key with more rows than this the rows are dealt out.
HOT = 20_000
SEGMENT = 1 << 22


def _segments(rids: list[int], texts: list[str], length: int) -> Iterator[tuple[int, int, str]]:
    """(rid, offset, text) with very long texts in pieces that overlap by length-1 characters."""
    for rid, text in zip(rids, texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            yield rid, at, text if len(text) <= SEGMENT else text[at : at + SEGMENT + length - 1]


def _contexts(texts: list[str], length: int, k: int):
    """Seed occurrences of a block: (text number, first window, windows, seed position, seed hash, context hash)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.cumsum([0, *map(len, texts)])
    h = K.prefix_hash(codes)
    n = len(codes) - k + 1
    if n < length - k + 1:
        return None
    kmer = K.scramble((h[k:] - h[:n]) * K.powers(K.INVERSE, n))
    low = K.window_minima(kmer, length - k + 1)
    window = np.arange(len(low))
    text = np.repeat(np.arange(len(texts)), np.diff(edge))[: len(low)]
    inside = np.flatnonzero(window + length <= edge[text + 1])
    low, window, text = low[inside], window[inside], text[inside]
    if not len(low):
        return None
    new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(new[1:], len(low)) - 1
    first, end, seed, text = window[new], window[last], low[new], text[new]
    context = K.scramble(K.stretch_hash(h, first, end + length) ^ K.scramble((seed - first).astype(K.U)))
    return text, first - edge[text], end - first + 1, seed - edge[text], kmer[seed], context


def _seeds(length: int, k: int):
    def run(batches):
        for b in batches:
            rids, texts = b.column("rid").to_pylist(), b.column("text").to_pylist()
            parts = [p for p in _segments(rids, texts, length) if len(p[2]) >= length]
            for s, e in K.blocks([p[2] for p in parts]):
                block = parts[s:e]
                found = _contexts([p[2] for p in block], length, k)
                if found is None:
                    continue
                text, first, count, seed, h, context = found
                rid = np.array([p[0] for p in block], np.int64)[text]
                at = np.array([p[1] for p in block], np.int64)[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(context.view(np.int64)),
                        pa.array(rid),
                        pa.array((seed + at).astype(np.int32)),
                        pa.array((first + at).astype(np.int32)),
                        pa.array(count.astype(np.int16)),
                    ],
                    names=["h", "context", "rid", "pos", "first", "windows"],
                )

    return run


def seeds(rows: DataFrame, length: int = LENGTH, k: int = SEED) -> DataFrame:
    """(rid, text) -> one row per seed occurrence."""
    return (
        rows.where(F.length("text") >= length)
        .select("rid", "text")
        .mapInArrow(_seeds(length, k), "h long, context long, rid long, pos int, first int, windows short")
    )


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def raise_to(self, i: int, item: tuple[float, int]) -> None:
        while i < len(self.best):
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """The maximum over positions 1..i."""
        top = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > top:
                top = self.best[i]
            i -= i & -i
        return top


def chains(matches: list[tuple[int, int]], weight: float, gap_cost: float = 0.05) -> list[list[tuple[int, int]]]:
    """Split matches (a, b) into collinear chains, the best first; each match is in exactly one chain.

    A chain's score is weight for each match less gap_cost for each character skipped in either text.
    """
    order = sorted(set(matches))
    if len(order) == 1:
        return [order]
    rank = {b: i + 1 for i, b in enumerate(sorted({b for _, b in order}))}
    tree, score, back = Fenwick(len(rank)), [0.0] * len(order), [-1] * len(order)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:  # equal a: none precedes another
            a, b = order[j]
            top, at = tree.before(rank[b] - 1)
            top -= gap_cost * (a + b)
            score[j] = weight + max(0.0, top)
            back[j] = at if top > 0 else -1
            j += 1
        for x in range(i, j):
            a, b = order[x]
            tree.raise_to(rank[b], (score[x] + gap_cost * (a + b), x))
        i = j
    used, out = [False] * len(order), []
    for x in sorted(range(len(order)), key=lambda x: (-score[x], x)):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(order[x])
            x = back[x]
        if chain:
            out.append(chain[::-1])
    return out


def _common(s: str, t: str) -> int:
    """Length of the common prefix."""
    if s.startswith(t) or t.startswith(s):
        return min(len(s), len(t))
    lo, hi = 0, min(len(s), len(t))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if s[lo:mid] == t[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if lo < min(len(s), len(t)) and s[lo] != t[lo] else hi


def _extend(a: str, b: str, i: int, j: int, k: int) -> tuple[int, int, int]:
    """The whole equal block (start in a, start in b, length) around a match of k characters."""
    after = _common(a[i + k :], b[j + k :])
    m = min(i, j)
    before = _common(a[i - m : i][::-1], b[j - m : j][::-1])
    return i - before, j - before, before + k + after


def edits(s: str, t: str) -> int:
    """Edit distance of two short strings."""
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        corner, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != d))
    return row[-1]


def passages(a: str, b: str, matches: list[tuple[int, int]], k: int, gap: int = GAP):
    """Aligned passages of two texts: (a_start, a_end, b_start, b_end, edits, equal blocks)."""
    sound = [(i, j) for i, j in matches if a[i : i + k] == b[j : j + k] and i + k <= len(a) and j + k <= len(b)]
    if not sound:
        return
    seen: set[tuple[int, int, int]] = set()
    for chain in chains(sound, k):
        run: list[tuple[int, int, int]] = []
        cost = 0
        for i, j in chain:
            if run and i - j == run[-1][0] - run[-1][1] and i + k <= run[-1][0] + run[-1][2]:
                continue  # inside the block before
            block = _extend(a, b, i, j, k)
            if block in seen:
                continue
            seen.add(block)
            if run:
                x, y, n = run[-1]
                skip = max(0, x + n - block[0], y + n - block[1])  # blocks on two diagonals may overlap
                s, t = a[x + n : block[0] + skip], b[y + n : block[1] + skip]
                if skip < block[2] and len(s) <= gap and len(t) <= gap:
                    cost += edits(s, t)
                else:
                    yield _passage(run, cost)
                    run, cost = [], 0
            run.append(block)
        if run:
            yield _passage(run, cost)


def _passage(run: list[tuple[int, int, int]], cost: int):
    x, y, n = run[-1]
    return run[0][0], x + n, run[0][1], y + n, cost, run


def _aligned(k: int, gap: int):
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                found = passages(r["text_a"], r["text_b"], [(m["pa"], m["pb"]) for m in r["matches"]], k, gap)
                for s, e, t, f, cost, blocks in found:
                    equal = [{"a": x, "b": y, "n": n} for x, y, n in blocks]
                    out.append((r["id_a"], s, e, r["id_b"], t, f, cost, equal))
            yield pa.RecordBatch.from_pylist([dict(zip(PASSAGE.names, x)) for x in out], PASSAGE)

    return run


_BLOCK = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
PASSAGE = pa.schema(
    [
        ("id_a", pa.string()),
        ("start_a", pa.int64()),
        ("end_a", pa.int64()),
        ("id_b", pa.string()),
        ("start_b", pa.int64()),
        ("end_b", pa.int64()),
        ("edits", pa.int64()),
        ("equal", pa.list_(_BLOCK)),
    ]
)
PASSAGE_DDL = (
    "id_a string, start_a long, end_a long, id_b string, start_b long, end_b long, edits long, "
    "equal array<struct<a: long, b: long, n: long>>"
)


class SharedSpans:
    """The operator. Build once on a table of records; passages(), spans() and report() are its results."""

    def __init__(self, chunks: DataFrame, length: int = LENGTH, k: int = SEED, fan: int = FAN, gap: int = GAP):
        if not 0 < k < length:
            raise ValueError("the seed must be shorter than the span")
        self.length, self.k, self.fan, self.gap = length, k, fan, gap
        self.rows = record_rows(chunks)
        found = staged(seeds(self.rows, length, k), "seeds")
        shared = found.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi")
        self.found = staged(only(found, staged(shared.select("h"), "shared-seeds"), "h"), "shared-occurrences")
        classes = self.found.groupBy("h", "context").agg(
            F.min(F.struct("rid", "pos")).alias("a"), F.max(F.struct("rid", "pos")).alias("b"), F.count("*").alias("n")
        )
        size = classes.groupBy("h").agg(F.count("*").alias("contexts"))
        self.classes = staged(
            classes.join(size, "h").withColumn("alone", F.col("a.rid") == F.col("b.rid")), "seed-classes"
        )

    def _matches(self, fan: int | None) -> DataFrame:
        """Matched seed occurrences, (rid, pos) with (other, opos); seeds with more than fan contexts are not crossed."""
        sizes = self.classes.select("h", "context", "n")
        mine = dealt_join(self.found, self.classes.drop("n"), ["h", "context"], sizes, "rid", HOT)
        star = mine.where("not alone").select(
            "rid", "pos", F.when(F.col("rid") != F.col("a.rid"), F.col("a")).otherwise(F.col("b")).alias("o")
        )
        other = self.classes.select("h", F.col("context").alias("context2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        crossed = F.col("alone") if fan is None else F.col("alone") & (F.col("contexts") <= fan)
        per_seed = self.classes.where(crossed).groupBy("h").agg((F.sum("n") * F.max("contexts")).alias("n"))
        cross = (
            dealt_join(mine.where(crossed).select("h", "context", "rid", "pos"), other, ["h"], per_seed, "rid", HOT * 50)
            .where("context <> context2 and (a2.rid <> rid or b2.rid <> rid)")
            .select("rid", "pos", F.when(F.col("rid") != F.col("a2.rid"), F.col("a2")).otherwise(F.col("b2")).alias("o"))
        )
        return star.unionByName(cross).select("rid", "pos", F.col("o.rid").alias("other"), F.col("o.pos").alias("opos"))

    def passages(self) -> DataFrame:
        """Fuzzy passages of pairs of records: both stretches, the edits between their equal blocks, the blocks.

        Pairs are those the matches name: each record with the first record of each of its contexts, and the records
        that hold different contexts of a seed with each other.
        """
        return self._passages(self._matches(None))

    def members(self) -> DataFrame:
        """(id, seed, context, pos, first, chars): the records of each shared seed, one row for each occurrence.

        Records with one seed have its k characters at pos in common, those with one context also the chars characters
        from first on. Any two records that share `length` characters have a seed in common.
        """
        ids = self.rows.select("rid", "id").distinct()
        chars = (F.col("windows") + F.lit(self.length - 1)).cast("long").alias("chars")
        seen = self.found.select("rid", F.col("h").alias("seed"), "context", F.col("pos").cast("long").alias("pos"), F.col("first").cast("long").alias("first"), chars)
        return seen.distinct().join(ids, "rid").select("id", "seed", "context", "pos", "first", "chars")

    def _passages(self, matches: DataFrame) -> DataFrame:
        swap = F.col("rid") > F.col("other")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        pairs = (
            matches.select(
                pick("rid", "other").alias("a"),
                pick("other", "rid").alias("b"),
                F.struct(pick("pos", "opos").alias("pa"), pick("opos", "pos").alias("pb")).alias("m"),
            )
            .groupBy("a", "b")
            .agg(F.collect_set("m").alias("matches"))
        )
        pairs = staged(pairs, "record-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
        texts = self._texts(staged(ids, "paired-records"))
        # The first record of a class is the lesser one: its text is sent once to each part of its partners.
        both = pairs.join(texts.select(F.col("rid").alias("b"), F.col("id").alias("id_b"), F.col("text").alias("text_b")), "b")
        first = texts.select(F.col("rid").alias("a"), F.col("id").alias("id_a"), F.col("text").alias("text_a"))
        both = dealt_join(both, first, ["a"], pairs.groupBy("a").agg(F.count("*").alias("n")), "b", HOT)
        both = both.select("id_a", "text_a", "id_b", "text_b", "matches")
        return both.mapInArrow(_aligned(self.k, self.gap), PASSAGE_DDL)

    def _texts(self, rids: DataFrame) -> DataFrame:
        return only(self.rows, rids, "rid").select("rid", "id", "text").dropDuplicates(["id"])

    def _window_matches(self) -> DataFrame | None:
        """Matches at seeds with more than fan contexts: each window with the first record that has it (and that one with
        another), of adjacent windows on one diagonal the first; None if there are no such seeds."""
        hot = self.classes.where(F.col("alone") & (F.col("contexts") > self.fan)).select("h", "context")
        if hot.isEmpty():
            return None
        all_of_hot = self.classes.where(F.col("contexts") > self.fan).select("h", "context", "n")
        at = dealt_join(self.found, all_of_hot.drop("n"), ["h", "context"], all_of_hot, "rid", HOT)
        at = at.groupBy("rid").agg(F.collect_set(F.struct("first", "windows")).alias("at"))
        at = staged(at, "hot-contexts")
        texts = self._texts(at.select("rid"))
        length = self.length

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    codes = np.frombuffer(r["text"].encode("utf-32-le", "surrogatepass"), np.uint32)
                    h = K.prefix_hash(codes)
                    s = np.unique(np.concatenate([np.arange(x["first"], x["first"] + x["windows"]) for x in r["at"]]))
                    s = s[s + length <= len(codes)]
                    w = K.scramble(K.stretch_hash(h, s, s + length))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w.view(np.int64)), pa.array(np.full(len(s), r["rid"], np.int64)), pa.array(s.astype(np.int32))], names=["w", "rid", "pos"]
                    )

        windows = texts.join(at, "rid").select("rid", "text", "at").mapInArrow(run, "w long, rid long, pos int")
        windows = staged(windows, "hot-windows")
        first = F.min(F.struct("rid", "pos")).alias("a"), F.max(F.struct("rid", "pos")).alias("b")
        classes = staged(windows.groupBy("w").agg(*first, F.count("*").alias("n")).where("a.rid <> b.rid"), "window-classes")
        met = dealt_join(windows, classes.drop("n"), ["w"], classes.select("w", "n"), "rid", HOT)
        met = met.select("rid", "pos", F.when(F.col("rid") != F.col("a.rid"), F.col("a")).otherwise(F.col("b")).alias("o"))
        met = met.select("rid", "pos", F.col("o.rid").alias("other"), F.col("o.pos").alias("opos")).distinct()
        before = F.lag("pos").over(Window.partitionBy("rid", "other", F.col("pos") - F.col("opos")).orderBy("pos"))
        return met.withColumn("before", before).where("before is null or before < pos - 1").drop("before")

    def spans(self) -> DataFrame:
        """(id, span_start, span_end): the maximal runs of characters shared with another record."""
        matches, windows = self._matches(self.fan), self._window_matches()
        matches = matches if windows is None else matches.unionByName(windows)
        equal = self._passages(matches).select("id_a", "id_b", F.explode("equal").alias("x")).where(F.col("x.n") >= self.length)
        both = equal.select(
            F.explode(
                F.array(
                    F.struct(F.col("id_a").alias("id"), F.col("x.a").alias("s"), (F.col("x.a") + F.col("x.n")).alias("e")),
                    F.struct(F.col("id_b").alias("id"), F.col("x.b").alias("s"), (F.col("x.b") + F.col("x.n")).alias("e")),
                )
            ).alias("y")
        ).select("y.*")
        both = both.distinct()
        w = Window.partitionBy("id").orderBy("s", "e")
        reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = both.withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1))
        marked = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy("id", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("run")

    def report(self) -> DataFrame:
        """(id, n_chars, shared_chars, spans) for each record of the table; zero where nothing is shared."""
        per = self.spans().groupBy("id").agg(
            F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("spans")
        )
        size = self.rows.select("id", F.length("text").cast("long").alias("n_chars")).distinct()
        return size.join(per, "id", "left").select(
            "id",
            "n_chars",
            F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
            F.coalesce("spans", F.lit(0)).alias("spans"),
        )
