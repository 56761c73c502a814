"""Problem 7: test passages in training text, by a distributed positional inverted index.

The index is stored in the shared folder. A row holds the postings of a block of documents in BUCKETS columns by term:
in each the sorted terms of that bucket and for each the ascending positions where it stands. It is built once, without a
shuffle, and serves any number of test sets; of a row only the columns of the test terms' buckets are read.

A test set is sent to all rows, in blocks of bounded size. The terms of each window of 13 consecutive words of an item (all
its words if it has fewer) are put in order of how often they occur in all documents. The positions of the rarest, less
its place in the window, are the offsets at which the window may lie; they are intersected with the positions, less
theirs, of the next rarest term, and so on until no offset or no term is left. The text is never put together again.

A proximity match needs `anchors` of a window's 2 * anchors rarest words, of those that occur at all, within a few words of
where the offset of one of them puts them; any of them may be missing. A window of n words needs n - 1 of them if that is
less, but 2 at least, or its only one. If not all the words sought are there, a match also counts only if at most `chance`
such matches of all windows asked would be expected in the whole corpus with its words strewn at random.

Defined results: words are runs of letters and digits of any script in the lower-cased text. Items without a word match
nothing. Null texts have no words; rows without doc_id or item_id are left out. Of several rows with one id each
counts. A document that holds an item twice is one case. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged
from . import kernels as K

WINDOW = 13
#: Test items are taken in blocks of about so many words (some 100 MB in a worker).
BLOCK_WORDS = 500_000
#: Columns of the index; a term's is given by the first bits of its hash.
BUCKET_BITS = 4
BUCKETS = 1 << BUCKET_BITS
INDEX = "docs binary, doc_starts binary, " + ", ".join(f"b{i} struct<terms: binary, starts: binary, positions: binary>" for i in range(BUCKETS))


def bucket_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> K.U(64 - BUCKET_BITS)).astype(np.int64)


def build_index(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> the stored index, a row for each block of documents.

    docs are 64-bit ids; doc_starts, list_starts and positions 32-bit numbers that count words of the block.
    """

    def run(batches):
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_numpy()
            for s, e in K.blocks(texts):
                w = K.Words(texts[s:e], unicode=True)
                order = np.argsort(w.hash, kind="stable")
                terms, first = np.unique(w.hash[order], return_index=True)
                first = np.append(first, len(order))
                row = {"docs": ids[s:e].tobytes(), "doc_starts": w.bound.astype(np.int32).tobytes()}
                cut = np.searchsorted(bucket_of(terms), np.arange(BUCKETS + 1))
                for i in range(BUCKETS):
                    lo, hi = cut[i], cut[i + 1]
                    own = first[lo : hi + 1]
                    row[f"b{i}"] = {"terms": terms[lo:hi].tobytes(), "starts": (own - own[0]).astype(np.int32).tobytes(), "positions": order[own[0] : own[-1]].astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_pylist([row], SCHEMA)

    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    return staged(rows.mapInArrow(run, INDEX), "positional-index")


_LISTS = pa.struct([(x, pa.binary()) for x in ("terms", "starts", "positions")])
SCHEMA = pa.schema([("docs", pa.binary()), ("doc_starts", pa.binary())] + [(f"b{i}", _LISTS) for i in range(BUCKETS)])


class Lists:
    """The postings lists of some sorted terms in one row of the index, by the terms' numbers."""

    def __init__(self, row: dict, terms: np.ndarray, cut: np.ndarray):
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.doc_starts = np.frombuffer(row["doc_starts"], np.int32).astype(np.int64)
        self.span = int(self.doc_starts[-1]) + 1
        self.size = np.zeros(len(terms), np.int64)
        found = []
        for i in range(BUCKETS):
            if cut[i] == cut[i + 1]:
                continue
            have = np.frombuffer(row[f"b{i}"]["terms"], np.uint64)
            if not len(have):
                continue
            mine = terms[cut[i] : cut[i + 1]]
            at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
            here = np.flatnonzero(have[at] == mine)
            starts = np.frombuffer(row[f"b{i}"]["starts"], np.int32).astype(np.int64)
            lo, size = starts[at[here]], starts[at[here] + 1] - starts[at[here]]
            self.size[cut[i] + here] = size
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found.append(np.frombuffer(row[f"b{i}"]["positions"], np.int32)[np.repeat(lo, size) + inner].astype(np.int64))
        self.positions = np.concatenate(found) if found else np.empty(0, np.int64)
        self.start = np.cumsum(self.size) - self.size
        # All lists end to end as one ascending list of (term, position).
        self.keys = np.repeat(np.arange(len(terms)) * self.span, self.size) + self.positions

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into numbers, position) for all postings of the terms with these numbers."""
        size = self.size[numbers]
        which = np.repeat(np.arange(len(numbers)), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return which, self.positions[self.start[numbers][which] + inner]

    def have(self, numbers: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term's list has the position."""
        if not len(self.keys):
            return np.zeros(len(numbers), bool)
        key = numbers * self.span + positions
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts[1:], positions, "right")


class Items:
    """A block of test items: the words of all of them end to end."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        w = K.Words(texts, unicode=True)
        self.ids, self.bound, self.window = np.array(ids, np.int64), w.bound.astype(np.int64), window
        self.terms, term = np.unique(w.hash, return_inverse=True)
        self.term = term.astype(np.int64)
        self.item = np.asarray(w.text, np.int64)
        self.cut = np.searchsorted(bucket_of(self.terms), np.arange(BUCKETS + 1))
        self.columns = [f"b{i}" for i in range(BUCKETS) if self.cut[i] < self.cut[i + 1]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words) of each window."""
        size = np.diff(self.bound)
        n = np.minimum(size, self.window)
        many = np.where(size > 0, size - n + 1, 0)
        first = np.repeat(self.bound[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return first, np.repeat(n, many)

    def ordered(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, places) of each window; places are those of its words, the rarest first (of equal ones the first)."""
        first, n = self.windows()
        place = np.arange(self.window)
        c = counts[self.term[np.minimum(first[:, None] + place, len(self.term) - 1)]]
        c = np.where(place < n[:, None], c, np.iinfo(np.int64).max)
        return first, n, np.argsort(c, axis=1, kind="stable")

    def candidates(self, counts: np.ndarray, anchors: int) -> tuple[np.ndarray, np.ndarray]:
        """(sought, need) for the window at each word: which of its words are looked for, and how many must be near.

        The words sought are the 2 * anchors rarest of those that occur; need is 0 where no window starts or too few occur.
        """
        sought, need = np.zeros((len(self.term), self.window), bool), np.zeros(len(self.term), np.int64)
        first, n, places = self.ordered(counts)
        if len(first):
            c = counts[self.term[np.minimum(first[:, None] + places, len(self.term) - 1)]]
            there = (np.arange(self.window) < n[:, None]) & (c > 0)
            least = np.minimum(np.minimum(anchors, np.maximum(n - 1, 2)), n)
            there &= (there.sum(1) >= least)[:, None]
            rank = np.cumsum(there, axis=1)
            w, r = np.nonzero(there & (rank <= 2 * anchors))
            sought[first[w], places[w, r]] = True
            need[first] = np.where(there.any(1), least, 0)
        return sought, need


class ItemBlocks:
    """The test items, block by block: they are the query, and pass through the driver, one block at a time."""

    def __init__(self, items: DataFrame, window: int):
        self.rows, self.window = items.where("item_id is not null and text is not null").select("item_id", "text"), window

    def __iter__(self) -> Iterator[Items]:
        ids, texts, size = [], [], 0
        for r in self.rows.toLocalIterator():
            ids.append(r[0])
            texts.append(r[1])
            size += len(r[1]) // 5
            if size > BLOCK_WORDS:
                yield Items(ids, texts, self.window)
                ids, texts, size = [], [], 0
        if ids:
            yield Items(ids, texts, self.window)

    def __len__(self) -> int:
        return sum(1 for _ in self)


def term_counts(index: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How often each of the items' terms occurs in all documents, and the words of these, from the index. Collects a row
    for each term."""
    terms, cut, columns = items.terms, items.cut, items.columns

    def run(batches):
        total, words = np.zeros(len(terms), np.int64), 0
        for b in batches:
            for r in b.to_pylist():
                words += int(np.frombuffer(r["doc_starts"], np.int32)[-1])
                for c in columns:
                    lo, hi = cut[int(c[1:])], cut[int(c[1:]) + 1]
                    have, starts = np.frombuffer(r[f"{c}_terms"], np.uint64), np.frombuffer(r[f"{c}_starts"], np.int32)
                    if len(have):
                        at = np.minimum(np.searchsorted(have, terms[lo:hi]), len(have) - 1)
                        total[lo:hi] += np.where(have[at] == terms[lo:hi], np.diff(starts)[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], words))], names=["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    if columns:
        read = index.select("doc_starts", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in columns for x in ("terms", "starts")])
        got = read.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


FOUND = "doc_id long, item_id long, pos long, first long, words long"


def _runs(item: np.ndarray, at: np.ndarray, window: np.ndarray, n: np.ndarray):
    """Windows found at offsets -> (item, offset, first word, words) of the longest runs that they make up."""
    order = np.lexsort((window, at - window, item))
    item, at, window, n = item[order], at[order], window[order], n[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - window[1:] != at[:-1] - window[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    return item[first], at[first], window[first], window[last] + n[last] - window[first]


def _exact(items: Items, counts: np.ndarray, total: int):
    """Index rows -> (doc_id, item_id, pos, first, words): the longest runs of an item's words that hold a window of it."""

    def run(batches):
        first, n, places = items.ordered(counts)
        for b in batches:
            for r in b.to_pylist():
                lists = Lists(r, items.terms, items.cut)
                absent = np.concatenate(([0], np.cumsum(lists.size[items.term] == 0)))
                w = np.flatnonzero(absent[first + n] == absent[first])
                which, pos = lists.of(items.term[first[w] + places[w, 0]])
                w = w[which]
                at = pos - places[w, 0]
                doc = lists.doc_of(pos)
                keep = (at >= lists.doc_starts[doc]) & (at + n[w] <= lists.doc_starts[doc + 1])
                w, at, doc = w[keep], at[keep], doc[keep]
                for k in range(1, items.window):
                    todo = n[w] > k
                    place = places[w, k]
                    keep = ~todo
                    keep[todo] = lists.have(items.term[(first[w] + place)[todo]], (at + place)[todo])
                    w, at, doc = w[keep], at[keep], doc[keep]
                    if not len(w):
                        break
                if len(w):
                    item, at, word, words = _runs(items.item[first[w]], at, first[w], n[w])
                    doc = lists.doc_of(at)
                    cols = [lists.docs[doc], items.ids[item], at - lists.doc_starts[doc], word - items.bound[item], words]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


#: So many postings, and so many places of items, are compared at once.
POSTINGS, PLACES = 4_000_000, 200_000


def _near(items: Items, counts: np.ndarray, total: int, anchors: int, slack: int, chance: float):
    """Index rows -> (doc_id, item_id, window): windows of which `need` sought words lie near where one of them puts them."""
    width = items.window
    # The log of how likely a word of this term stands within slack of a place.
    odds = np.log(np.minimum(1.0, (2 * slack + 1) * np.maximum(counts, 1) / max(total, 1)))[items.term] if len(counts) else np.empty(0)
    often = np.log(np.maximum(counts, 1))[items.term] if len(counts) else np.empty(0)

    def met(lists: Lists, here: np.ndarray, least: int, sought: np.ndarray, need: np.ndarray):
        """(position, window) of the windows that are met, from the postings of some items' sought words."""
        which, pos = lists.of(items.term[here])
        word = here[which]
        # Of each word the offset at which its item would begin; few have enough others of the item next to them.
        offset = pos - word + items.bound[items.item[word]]
        far = 2 * (lists.span + int(items.bound[-1]) + slack)
        key = items.item[word] * far + offset
        order = np.argsort(key)
        key, pos, word = key[order], pos[order], word[order]
        close = np.zeros(len(key), bool)
        start = np.flatnonzero(key[least - 1 :] - key[: len(key) - least + 1] <= 2 * slack)
        for d in range(least):
            close[start + d] = True
        pos, word = pos[close], word[close]
        if not len(pos):
            return
        span = lists.span + 2 * slack + 2
        near_by = np.sort(word * span + pos)
        for at in range(0, len(pos), PLACES):
            p, w = pos[at : at + PLACES], word[at : at + PLACES]
            doc, item = lists.doc_of(p), items.item[w]
            first, last = lists.doc_starts[doc], lists.doc_starts[doc + 1] - 1
            near = np.zeros((len(p), 2 * width - 1), bool)  # the words from width - 1 before w to as many behind it
            for d in range(1 - width, width):
                lo, hi = (w + d) * span + np.maximum(p + d - slack, first), (w + d) * span + np.minimum(p + d + slack, last)
                found = near_by[np.minimum(np.searchsorted(near_by, lo), len(near_by) - 1)]
                near[:, d + width - 1] = (found >= lo) & (found <= hi) & (w + d >= items.bound[item]) & (w + d < items.bound[item + 1])
            for d in range(width):  # w is word d of the window
                ok = np.flatnonzero(w - d >= items.bound[item])
                ok = ok[(need[w[ok] - d] > 0) & sought[w[ok] - d, d]]
                ok = ok[(near[ok, width - 1 - d : 2 * width - 1 - d] & sought[w[ok] - d]).sum(axis=1) >= need[w[ok] - d]]
                here = near[ok, width - 1 - d : 2 * width - 1 - d] & sought[w[ok] - d]
                words = np.minimum(w[ok][:, None] - d + np.arange(width), len(odds) - 1)
                expected = often[w[ok]] - odds[w[ok]] + (odds[words] * here).sum(axis=1)
                ok = ok[(expected <= np.log(chance / max(np.count_nonzero(need), 1))) | (here == sought[w[ok] - d]).all(axis=1)]
                yield p[ok], w[ok] - d

    def run(batches):
        sought, need = items.candidates(counts, anchors)
        used = np.zeros(len(need), bool)  # words sought in any window
        for d in range(width):
            used[d:] |= sought[: len(need) - d, d]
        # The least need of an item's windows; items with equal ones are taken together.
        least = np.full(len(items.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, items.item[need > 0], need[need > 0])
        for b in batches:
            for r in b.to_pylist():
                lists = Lists(r, items.terms, items.cut)
                for level in np.unique(least[least < np.iinfo(np.int64).max]):
                    here = np.flatnonzero(used & (least[items.item] == level) & (lists.size[items.term] > 0))
                    if not len(here):
                        continue
                    # Whole items at a time, as many as have POSTINGS together.
                    total = np.cumsum(lists.size[items.term[here]])
                    part = (total - 1) // POSTINGS
                    part = part[np.searchsorted(items.item[here], items.item[here])]
                    for x in np.unique(part):
                        for pos, window in met(lists, here[part == x], int(level), sought, need):
                            if not len(pos):
                                continue
                            cases = np.unique(np.stack([lists.doc_of(pos), window], axis=1), axis=0)
                            cols = [lists.docs[cases[:, 0]], items.ids[items.item[cases[:, 1]]], cases[:, 1]]
                            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["doc_id", "item_id", "window"])

    return run


class LeakSearch:
    """Test items against all documents. index: a stored one, else it is built."""

    def __init__(self, documents: DataFrame, items: DataFrame, window: int = WINDOW, index: DataFrame | None = None):
        self.spark = documents.sparkSession
        self.index = build_index(documents) if index is None else index
        self.blocks = ItemBlocks(items, window)

    def _all(self, kind, ddl: str) -> DataFrame:
        """kind(items, counts) run over the index for each block of items; each but the last is stored before the next is read."""
        out = None
        for items in self.blocks:
            found = self.index.select("docs", "doc_starts", *items.columns).mapInArrow(kind(items, *term_counts(self.index, items)), ddl)
            out = found if out is None else staged(out, "block-found").unionByName(found)
        return self.spark.createDataFrame([], ddl) if out is None else out

    def exact(self) -> DataFrame:
        """(doc_id, item_id, pos, first, words): word runs of an item, from its word `first`, at word pos of a document.

        Runs are the longest that hold a whole window, and lie within one document.
        """
        return self._all(_exact, FOUND)

    def near(self, anchors: int = 4, slack: int = 6, chance: float = 10.0) -> DataFrame:
        """(doc_id, item_id, windows): documents with enough of the rare words of an item's windows near their places.

        Finds passages with small edits, also where rare words were changed; windows counts the windows of the item that are met in the document.
        """
        met = self._all(lambda items, counts, total: _near(items, counts, total, anchors, slack, chance), "doc_id long, item_id long, window long").distinct()
        return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"))
