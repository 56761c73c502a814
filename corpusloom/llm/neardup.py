"""Problem 4: near-duplicate records, by adaptive multi-match prefixes.

Each record is the set of its three-word runs. Records with equal sets are one class and are compared once. A set gets
a prefix of its rarest shingles; where the prefix would meet many postings, it is lengthened and more shared prefix
shingles (l) are required. Two sets are verified if they share at least the smaller l of the two, and as many as sets of
their sizes must share in prefixes of these lengths. Pairs that differ too
much in size, or in a parity sketch of the whole sets (a lower bound of their difference), are left out where they meet.
Postings travel in packed blocks to the bucket of their shingle, one bucket a task. A block has its postings in order of
their shingles, so that a posting has nearly the same size at any number of buckets; in order of sets it would live on
repeated sketches, which get rare as buckets get many. A shingle in more than SPLIT prefixes is split by blocks of sets,
each pair of blocks in one bucket: where the table of common shingles knows it, before it is sent; any other is counted in
its bucket, whole, and its postings are sent on to a second round in the same blocks.

Defined results: the words of a record are those of heading, a space and text; null headings and texts count as ''.
Rows of one id are one record (see record_rows). Records of fewer than 20 words take no part. Records that are copies of
each other are pairs as well. Very long texts are one set like any other. Empty tables give no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import record_rows
from ..operators.sizes import only
from ..scratch import staged
from . import kernels as K
from .components import components
from .prefixes import COMMON, Common, Likeness, order, prefix_length, set_key, survey

KIND = Likeness(words=3, least=Fraction(3, 5), min_words=20)
#: A shingle in more prefixes than this is split over several reducers.
SPLIT = 20_000
POSTING = np.dtype([("token", "<u8"), ("set", "<u8"), ("bits", "<u8", 3), ("n", "<u4"), ("l", "u1"), ("side", "u1")])
WHOLE = 255
SKETCH = 192
#: Low bytes of a shingle that travel; the bucket tells the rest apart. Shingles of two sets taken for one only make a
#: candidate more; two of one set would be counted once, for 1 in 2**40 pairs of its shingles in one bucket.
TOKEN_BYTES = 5


def parity(a: np.ndarray) -> np.ndarray:
    """192 bits: for each remainder by 192 whether the set has an odd number of such shingles.

    Two sets differ in at least as many shingles as their parities differ in bits.
    """
    return np.packbits((np.bincount((a % K.U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).view(np.uint64)


def sketched(n, kind: Likeness):
    """Whether sets of n shingles travel with their parities; n a number or an array.

    Parities of sets that have nothing in common differ in half of the bits. Where even the smallest partner may differ
    in 5/8 of them, they tell nothing.
    """
    p, q = kind.least.numerator, kind.least.denominator
    return n * (q - p) * 8 < 5 * SKETCH * q


def _split(p: np.ndarray, counts: np.ndarray, most: int):
    """Postings -> those of shingles that few have, and, array by array, the others under the pairs of their blocks."""
    parts = -(-counts // most)
    hot = parts > 1
    yield p if not hot.any() else p[~hot]
    for s in np.unique(parts[hot]):
        mine = p[parts == s]
        block = (mine["set"] % K.U(s)).astype(np.int64)
        for other in range(int(s)):
            q = mine.copy()
            lo, hi = np.minimum(block, other), np.maximum(block, other)
            q["token"] = K.scramble(q["token"] ^ (lo * s + hi + 1).astype(K.U))
            q["side"] = np.where(lo == hi, WHOLE, block > other)
            yield q


def _octets(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)


def _blobs(p: np.ndarray, buckets: int, kind: Likeness):
    """(bucket, blob) of packed postings: column by column, in order of the shingles, sketches of those that have one."""
    b = ((p["token"] >> K.U(32)) % K.U(buckets)).astype(np.int64)
    o = np.lexsort((p["token"], b))
    p, b = p[o], b[o]
    token, key, n, l, side = _octets(p["token"])[:, :TOKEN_BYTES], _octets(p["set"]), _octets(p["n"]), p["l"].copy(), p["side"].copy()
    with_bits = sketched(p["n"].astype(np.int64), kind)
    bits, bits_at = p["bits"][with_bits], np.concatenate(([0], np.cumsum(with_bits)))
    at = np.searchsorted(b, np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(at)):
        for s in range(at[i], at[i + 1], 50_000):
            e = min(s + 50_000, at[i + 1])
            columns = token[s:e], key[s:e], n[s:e].T, l[s:e], side[s:e], bits[bits_at[s] : bits_at[e]]
            yield int(i), b"".join([int(e - s).to_bytes(4, "little"), *(x.tobytes() for x in columns)])


def _unpacked(blob: bytes, kind: Likeness) -> np.ndarray:
    """The postings of a blob, of their shingles the low bytes, of those without a sketch zeros for it."""
    m = int.from_bytes(blob[:4], "little")
    octets, at = np.frombuffer(blob, np.uint8), 4

    def column(width: int) -> np.ndarray:
        nonlocal at
        at += width * m
        return octets[at - width * m : at]

    p = np.zeros(m, POSTING)
    token = np.zeros((m, 8), np.uint8)
    token[:, :TOKEN_BYTES] = column(TOKEN_BYTES).reshape(m, TOKEN_BYTES)
    p["token"] = token.view("<u8").ravel()
    p["set"] = np.frombuffer(column(8).tobytes(), "<u8")
    p["n"] = np.ascontiguousarray(column(4).reshape(4, m).T).view("<u4").ravel()
    p["l"], p["side"] = column(1), column(1)
    p["bits"][sketched(p["n"].astype(np.int64), kind)] = np.frombuffer(octets[at:].tobytes(), "<u8").reshape(-1, SKETCH // 64)
    return p


def _postings(kind: Likeness, common: Common, buckets: int, most: int):
    """words -> (bucket, blob) of packed postings."""

    def packed(held: list[np.ndarray]):
        p = np.concatenate(held)
        for i, blob in _blobs(np.concatenate(list(_split(p, common.of(p["token"]), most))), buckets, kind):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            texts = batch.column("words").to_pylist()
            for s, e in K.blocks(texts):
                for a, words in K.shingle_sets(texts[s:e], kind.words):
                    if words < kind.min_words or not len(a):
                        continue
                    key = set_key(a)
                    if key in seen:
                        continue
                    seen.add(key)
                    bits = parity(a)
                    a, counts = order(a, common)
                    l, p = prefix_length(len(a), kind, counts)
                    q = np.empty(p, POSTING)
                    q["token"], q["set"], q["bits"], q["n"], q["l"], q["side"] = a[:p], key, bits, len(a), l, WHOLE
                    held.append(q)
                    size += p
                if size > 500_000:
                    yield from packed(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from packed(held)

    return run


def _summed(a, b, n_a, n_b, need, count):
    """Add up the counts of equal pairs."""
    key = K.scramble(a ^ K.scramble(b))
    o = np.argsort(key)
    key = key[o]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    first = o[new]
    return a[first], b[first], n_a[first], n_b[first], need[first], np.add.reduceat(count[o], new)


MET = "a long, b long, n_a int, n_b int, need int, met long, bucket int, blob binary"


def _met(kind: Likeness, buckets: int, most: int | None):
    """Packed postings of whole buckets -> (a, b, n_a, n_b, need, met): pairs of sets that share prefix shingles.

    The postings of a shingle that more than `most` of them have come out again instead, in blocks, as (bucket, blob).
    """
    p_, q_ = kind.least.numerator, kind.least.denominator
    names = [x.split()[0] for x in MET.split(", ")]

    def out(x):
        a, b, n_a, n_b, need, met = x
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
                pa.array(n_a.astype(np.int32)),
                pa.array(n_b.astype(np.int32)),
                pa.array(need.astype(np.int32)),
                pa.array(met.astype(np.int64)),
                pa.nulls(len(a), pa.int32()),
                pa.nulls(len(a), pa.binary()),
            ],
            names=names,
        )

    def sent_on(p):
        for i, blob in _blobs(p, buckets, kind):
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.array([i], pa.int32()), pa.array([blob], pa.binary())], names=names)

    def run(batches):
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if not blobs:
            return
        p = np.concatenate([_unpacked(x, kind) for x in blobs])
        del blobs
        p = p[np.lexsort((p["set"], p["n"], p["token"]))]
        same = (p["token"][1:] == p["token"][:-1]) & (p["set"][1:] == p["set"][:-1]) & (p["side"][1:] == p["side"][:-1])
        p = p[np.concatenate(([True], ~same))]
        if most is not None:
            edge = np.flatnonzero(np.concatenate(([True], p["token"][1:] != p["token"][:-1], [True])))
            counts = np.repeat(np.diff(edge), np.diff(edge))
            few, *hot = _split(p, np.where(p["side"] == WHOLE, counts, 1), most)
            for q in hot:
                yield from sent_on(q)
            p = few
        token, n, l, bits = p["token"].copy(), p["n"].astype(np.int64), p["l"].astype(np.int64), p["bits"].copy()
        i, d, held, size = np.arange(len(p)), 1, [], 0
        while len(i):
            i = i[i + d < len(p)]
            j = i + d
            ok = (token[i] == token[j]) & (n[i] * q_ >= n[j] * p_)  # sorted by n: what fails here fails farther on
            i, j = i[ok], j[ok]
            both = n[i] + n[j]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            overlap = -(-both * p_ // (p_ + q_))
            use = ((apart <= both - 2 * overlap) | ~sketched(n[j], kind)) & ((p["side"][i] != p["side"][j]) | (p["side"][i] == WHOLE))
            s, t, overlap = i[use], j[use], overlap[use]
            # Of the set whose prefix ends first, none of the prefix is in the other's rest: overlap <= met + own rest.
            rest = np.maximum(-(-n[s] * p_ // q_) - l[s], -(-n[t] * p_ // q_) - l[t])
            need = np.maximum(np.minimum(l[s], l[t]), overlap - rest)
            x, y = p[s], p[t]
            swap = x["set"] > y["set"]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            if len(x):
                held.append((x["set"], y["set"], x["n"], y["n"], need, np.ones(len(x), np.int64)))
                size += len(x)
            if size > 500_000:
                yield out(_summed(*map(np.concatenate, zip(*held))))
                held, size = [], 0
            d += 1
        if held:
            yield out(_summed(*map(np.concatenate, zip(*held))))

    return run


class NearDuplicates:
    """The operator: pairs of alike records and the groups they form."""

    def __init__(self, chunks: DataFrame, kind: Likeness = KIND, postings_per_bucket: int = 1_000_000, common: int = COMMON):
        self.kind = kind
        rows = record_rows(chunks)
        self.rows = rows.select("id", "rid", F.concat_ws(" ", "heading", "text").alias("words"))
        found, self.common, total = survey(self.rows, kind, common)
        self.members = found.withColumnRenamed("size", "n").distinct()
        self.buckets = max(8, total // postings_per_bucket)

    def candidates(self) -> DataFrame:
        """Pairs of sets (a < b) that share enough prefix shingles."""
        first = _postings(self.kind, self.common, self.buckets, SPLIT)
        blobs = self.rows.select("words").mapInArrow(first, "bucket int, blob binary")
        placed = lambda df: df.repartitionById(self.buckets, "bucket").select("blob")
        met = staged(placed(blobs).mapInArrow(_met(self.kind, self.buckets, SPLIT), MET), "met-sets")
        again = met.where("blob is not null")
        met = met.where("blob is null")
        if not again.isEmpty():
            met = met.unionByName(placed(again).mapInArrow(_met(self.kind, self.buckets, None), MET))
        return met.groupBy("a", "b", "n_a", "n_b", "need").agg(F.sum("met").alias("met")).where("met >= need")

    def links(self) -> DataFrame:
        """Pairs of sets that are alike: (a, b, both, n_a, n_b)."""
        pairs = staged(self.candidates().select("a", "b", "n_a", "n_b"), "candidate-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        first = self.members.groupBy("set").agg(F.min("id").alias("id"))
        rids = staged(first.join(wanted, "set").select(F.xxhash64("id").alias("rid")).distinct(), "candidate-records")
        words = self.kind.words

        def run(batches):
            for b in batches:
                texts = b.column("words").to_pylist()
                for s, e in K.blocks(texts):
                    sets = [a for a, _ in K.shingle_sets(texts[s:e], words)]
                    keys = np.array([set_key(a) for a in sets], K.U).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array([a.view(np.int64) for a in sets], pa.list_(pa.int64()))], names=["set", "shingles"]
                    )

        sets = only(self.rows, rids, "rid").select("words").mapInArrow(run, "set long, shingles array<long>")
        sets = staged(sets.dropDuplicates(["set"]), "candidate-sets")
        both = (
            pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), "n_a", "n_b")
        )
        return both.where(self.kind.alike(F.col("both"), F.col("n_a"), F.col("n_b")))

    def pairs(self) -> DataFrame:
        """All pairs of alike records, (id_a, id_b), id_a < id_b."""
        m = self.members
        linked = (
            self.links()
            .select("a", "b")
            .join(m.select(F.col("set").alias("a"), F.col("id").alias("x")), "a")
            .join(m.select(F.col("set").alias("b"), F.col("id").alias("y")), "b")
            .select("x", "y")
        )
        return linked.unionByName(self._copies()).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def _copies(self, block: int = 1000) -> DataFrame:
        """Pairs within classes, x < y. A large class is dealt out to blocks, each pair of blocks its own join key."""
        size = self.members.groupBy("set").agg(F.count("*").alias("size")).where("size > 1")
        own = self.members.join(size, "set").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        own = own.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        every = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        x = every.select("set", F.col("mine").alias("i"), F.col("other").alias("j"), F.col("id").alias("x"))
        y = every.select("set", F.col("other").alias("i"), F.col("mine").alias("j"), F.col("id").alias("y"))
        return x.join(y, ["set", "i", "j"]).where("x < y").select("x", "y")

    def groups(self) -> DataFrame:
        """Each record's group (its least id), its exact copies and the records linked to it.

        (id, group_id, copies, links): records that are alike directly or through others are one group. Records without
        partner form groups of their own.
        """
        links = staged(self.links().select("a", "b"), "links")
        label = components(links)
        named = self.members.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        group = named.groupBy("component").agg(F.min("id").alias("group_id"))
        size = self.members.groupBy("set").agg(F.count("*").alias("size"))
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = ends.join(size.withColumnRenamed("set", "b"), "b").groupBy("a").agg(F.sum("size").alias("links"))
        return (
            named.join(size, "set")
            .join(group, "component")
            .join(degree.withColumnRenamed("a", "set"), "set", "left")
            .select(
                "id",
                "group_id",
                (F.col("size") - 1).alias("copies"),
                (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
            )
        )
