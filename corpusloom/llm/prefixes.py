"""Prefix filtering of shingle sets, shared by the near-duplicate operators.

Sets are ordered by how common their shingles are, the rarest first, ties by hash. If two sets are alike to degree t,
their prefixes of n - ceil(t n) + l shingles share at least l of them. The order is a matter of cost alone: any order
common to all sets gives the same pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged
from . import kernels as K

#: The table of common shingles holds at most so many (1 MB); others count as rare, which bears on cost alone.
COMMON = 65_536
FLUSH = 4_000_000


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words; alike from `least` (numerator, denominator) on; shorter texts take no part."""

    words: int
    least: Fraction
    min_words: int = 0

    def need(self, n: int) -> int:
        """The least overlap that a set of n shingles has with any set alike to it."""
        return -(-self.least.numerator * n // self.least.denominator)

    def alike(self, both, n_a, n_b):
        """Whether an overlap is enough; of numbers or of Columns."""
        p, q = self.least.numerator, self.least.denominator
        return both * (p + q) >= (n_a + n_b) * p


class Common:
    """How many texts hold each common shingle, as measured over the whole collection."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.tokens & K.U((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        maybe = np.flatnonzero(self.seen[(a & K.U((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, a[maybe]), len(self.tokens) - 1)
            hit = self.tokens[at] == a[maybe]
            out[maybe[hit]] = self.counts[at[hit]]
        return out


def set_key(a: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(a.tobytes())


SURVEY = "id string, set long, size int, token long, n long"


def _survey(kind: Likeness):
    """Rows of two kinds: (id, set, size) of each text that takes part, and (token, n) counts of a block of texts."""

    def rows(ids=(), sets=(), sizes=(), tokens=(), counts=()):
        m, k = [None] * len(ids), [None] * len(tokens)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*ids, *k], pa.string()),
                pa.array(np.array(sets, K.U).view(np.int64).tolist() + k, pa.int64()),
                pa.array([*sizes, *k], pa.int32()),
                pa.concat_arrays([pa.array(m, pa.int64()), pa.array(tokens, pa.int64())]),
                pa.concat_arrays([pa.array(m, pa.int64()), pa.array(counts, pa.int64())]),
            ],
            names=["id", "set", "size", "token", "n"],
        )

    def flush(held: list[np.ndarray]):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 4
        return rows(tokens=tokens[often].view(np.int64), counts=counts[often])

    def run(batches):
        held: list[np.ndarray] = []
        size = total = 0
        for b in batches:
            texts, names = b.column("words").to_pylist(), b.column("id").to_pylist()
            for s, e in K.blocks(texts):
                ids, sets, sizes = [], [], []
                for name, (a, words) in zip(names[s:e], K.shingle_sets(texts[s:e], kind.words)):
                    if words < kind.min_words or not len(a):
                        continue
                    held.append(a)
                    size += len(a)
                    ids.append(name)
                    sets.append(set_key(a))
                    sizes.append(len(a))
                yield rows(ids, sets, sizes)
                if size >= FLUSH:
                    yield flush(held)
                    total, size, held = total + size, 0, []
        if held:
            yield flush(held)
        yield rows(tokens=[0], counts=[total + size])

    return run


def survey(texts: DataFrame, kind: Likeness, most: int = COMMON) -> tuple[DataFrame, Common, int]:
    """A table (id string, words string) -> the set of each text, the most common shingles, the number of shingles.

    The first is (id, set, size) with the set's 64-bit key, for the texts that take part. Every text is counted. Counts
    are gathered in blocks of some 40,000 texts, and a shingle that stands in fewer than four texts of a block adds
    nothing to its count; what this leaves out is rare everywhere.
    """
    found = staged(texts.select("id", "words").mapInArrow(_survey(kind), SURVEY), "survey")
    n = found.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    rows = n.orderBy(F.col("token") != 0, F.desc("n"), "token").limit(most + 1).toArrow()  # bounded by COMMON
    tokens, counts = rows.column("token").to_numpy().view(K.U), rows.column("n").to_numpy()
    is_total = tokens == 0
    return found.where("set is not null").select("id", "set", "size"), Common(tokens[~is_total], counts[~is_total]), int(counts[is_total].sum())


def order(a: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """The set in prefix order, and the counts of its shingles."""
    n = common.of(a)
    if n.any():
        o = np.argsort(n, kind="stable")
        return a[o], n[o]
    return a, n


def prefix_length(n: int, kind: Likeness, counts: np.ndarray, most: int = 16, verify: float = 0.4) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost.

    A prefix costs its own postings and the postings it meets: those of common shingles as counted, half a posting for a
    rare one. Of the sets met, about half as many share one more shingle each time, and those that share enough have to be
    verified, at a cost that grows with their size. Enough is l with the smallest partner that a set can have; with a partner
    of its own size it is more, by as much as the overlap of the two must be larger, and half of that is reckoned with. So
    sets of common shingles take a longer prefix and ask for more matches; to others a longer prefix costs more than it
    saves.
    """
    need = kind.need(n)
    p, q = kind.least.numerator, kind.least.denominator
    spare = (2 * n * p / (p + q) - need) / 2
    first = n - need + 1
    ls = np.arange(1, max(2, min(most, need) + 1))
    ps = np.minimum(first + ls - 1, n)
    met = np.cumsum(np.maximum(counts, 0.5))[ps - 1]
    best = int(np.argmin(4 * ps + met * (1 + verify * n * 0.5 ** (ls - 1 + spare))))
    return int(ls[best]), int(ps[best])
