"""Problem 5: deduplicating new batches against all history, with an incremental inverted index.

The index holds, for each distinct accepted text, the rare-shingle prefix as postings (token, node, set size) in folders
by token, its shingle set, and the files that have it; a text's node is the number of its first file. A batch is probed
with its own prefixes: only the folders of its tokens are read, candidates are filtered by length and by how many prefix
shingles they must share, and the few that are left verified on their sets. What is accepted is appended; nothing that is stored is written again but by compact(). The
order of shingles is frozen when the index is made (by how common they are in the first history), so old postings stay
valid; later shingles count as rare.

A batch of up to sizes.BROADCAST_KEYS prefix tokens is broadcast to the postings, so that no token gathers in one task;
of a larger one tokens in more than HOT texts are dealt out over several tasks. Texts are compared by sha256.

Within a batch, files are taken by number. Files with one text are one node; of the others none can be accepted. Among
the nodes that match no history, those without an earlier undecided neighbour are accepted, their neighbours refused,
and so on: in one task where the candidate pairs were counted to be few, else in rounds of joins, each of which settles
every node that has no undecided earlier neighbour.

Defined results: a text is its content decoded as strict UTF-8 with line ends turned into '\\n'; files that cannot be
decoded, are blank, or have a null content, file_no or batch_no take no part. Repeated rows of a file_no are one file, of
its first batch (of differing contents there the least hash). A file in batch 0 or in the manifest is accepted; a
manifest row counts with its sha256 (stripped, lower case; null matches nothing) only if no row of files has its
file_no. Texts of fewer than three words match only equal texts. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, decode_utf8, is_blank, strip
from ..operators.commit import Pointer
from ..operators.sizes import BROADCAST_KEYS, by_size
from ..scratch import scratch_path, staged
from . import kernels as K
from .prefixes import Common, Likeness, order, survey

KIND = Likeness(words=3, least=Fraction(7, 10))
#: A folder of postings gets about so many of the first history's; there are BUCKETS at least.
BUCKET_POSTINGS, BUCKETS = 2_000_000, 8
#: A token in more of a batch's texts than this is split where tokens are shuffled.
HOT = 10_000
#: So many appended parts are put together by compact().
PARTS = 64


def file_texts(files: DataFrame) -> DataFrame:
    """files -> (file_no, batch_no, text, sha), one row per file that takes part."""
    rows = files.where("file_no is not null and batch_no is not null").select("file_no", "batch_no", decode_utf8(F.col("content")).alias("text"))
    rows = rows.where(~is_blank(F.col("text"))).withColumn("sha", content_hash(F.col("text")))
    return rows.groupBy("file_no").agg(F.min(F.struct("batch_no", "sha", "text")).alias("r")).select("file_no", "r.*")


def _prepared(kind: Likeness, common: Common):
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            n, sets, prefixes = [], [], []
            for s, e in K.blocks(texts):
                for a, _ in K.shingle_sets(texts[s:e], kind.words):
                    n.append(len(a))
                    sets.append(a.view(np.int64))
                    prefixes.append(order(a, common)[0][: len(a) - kind.need(len(a)) + 1].view(np.int64) if len(a) else a.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("batch_no"), b.column("sha"), b.column("node"), pa.array(n, pa.int32()), pa.array(sets, longs), pa.array(prefixes, longs)],
                names=["batch_no", "sha", "node", "n", "shingles", "prefix"],
            )

    return run


def _settled(batches):
    """All matches of a batch -> the nodes that are refused when nodes are accepted in order."""
    told, before = set(), {}
    for b in batches:
        for node, other, held in zip(*(b.column(c).to_pylist() for c in ("node", "other", "held"))):
            if held:
                told.add(node)
            else:
                before.setdefault(max(node, other), []).append(min(node, other))
    refused = set(told)
    for node in sorted(before):
        if node not in refused and any(x not in refused for x in before[node]):
            refused.add(node)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(refused), pa.int64())], names=["node"])


def first_come(edges: DataFrame) -> DataFrame:
    """(lo, hi) edges, lo earlier -> the nodes (node) that are refused when nodes are accepted in order.

    A node is accepted unless an accepted earlier neighbour stands against it. Each round settles the nodes without an
    undecided earlier neighbour and their neighbours; the rounds needed are at most the longest rising path.
    """
    now = staged(edges, "edges")
    refused = None
    while not now.isEmpty():
        firsts = now.select("lo").distinct().join(now.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti")
        out = staged(now.join(firsts, "lo").select(F.col("hi").alias("node")).distinct(), "refused")
        refused = out if refused is None else refused.unionByName(out)
        now = now.join(out.withColumnRenamed("node", "hi"), "hi", "left_anti").join(out.withColumnRenamed("node", "lo"), "lo", "left_anti")
        now = staged(now.select("lo", "hi"), "edges")
    return refused if refused is not None else edges.select(F.col("lo").alias("node")).limit(0)


MATCHES = "node long, other long, held boolean"


class HistoryIndex:
    """The index in a folder that all executors share; a scratch one if path is None."""

    _ddl = "token long, node long, n int, shingles array<long>, sha string, file_no long"
    _columns = {"postings": ["token", "node", "n"], "sets": ["node", "n", "shingles"], "holders": ["sha", "node", "file_no"]}

    def __init__(self, spark: SparkSession, path: str | None = None, kind: Likeness = KIND, common: Common | None = None, postings: int = 0, small: int = BROADCAST_KEYS):
        """postings: about how many the first part will have; small: what is broadcast, or settled in one task, has so many rows at most."""
        self.spark, self.kind, self.small, self.path = spark, kind, small, path or scratch_path(spark, "history-index")
        self._pointer = Pointer(spark, self.path)
        state = self._pointer.read()
        if state:
            t = spark.read.parquet(f"{self.path}/{state['order']}").toArrow()  # bounded by prefixes.COMMON
            common = Common(t.column("token").to_numpy().view(K.U), t.column("n").to_numpy())
        else:
            common = common or Common(np.empty(0, K.U), np.empty(0, np.int64))
            t = pa.table({"token": common.tokens.view(np.int64), "n": common.counts.astype(np.int64)})
            state = {"order": f"order-{uuid.uuid4().hex[:8]}", "parts": [], "buckets": max(BUCKETS, -(-postings // BUCKET_POSTINGS))}
            spark.createDataFrame(t, "token long, n long").coalesce(1).write.parquet(f"{self.path}/{state['order']}")
        self.common, self._state = common, state

    def _bucket(self, c: str):
        return F.pmod(F.xxhash64(c), F.lit(self._state["buckets"])).cast("int")

    def table(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all parts, or those in some of the folders."""
        parts = [f"{self.path}/{p}/kind={kind}" for p in self._state["parts"] if self._pointer.exists(f"{p}/kind={kind}")]
        if not parts:
            return self.spark.createDataFrame([], self._ddl).select(*self._columns[kind])
        out = self.spark.read.schema(f"{self._ddl}, bucket int").option("basePath", self.path).parquet(*parts)
        return (out if buckets is None else out.where(F.col("bucket").isin(buckets))).select(*self._columns[kind])

    def prepare(self, texts: DataFrame) -> DataFrame:
        """(batch_no, sha, node, text) -> with n, shingles and prefix in place of the text."""
        ddl = "batch_no int, sha string, node long, n int, shingles array<long>, prefix array<long>"
        return texts.select("batch_no", "sha", "node", "text").mapInArrow(_prepared(self.kind, self.common), ddl)

    def append(self, texts: DataFrame, holders: DataFrame | None = None) -> None:
        """Add accepted texts (sha, node, n, shingles, prefix) and the files that have them (sha, node, file_no), each node
        itself if none are given. A run that dies on the way leaves the index as it was."""
        null = lambda kind: F.lit(None).cast(kind)
        row = lambda kind, token="bigint", node="bigint", n="int", shingles="array<bigint>", sha="string", file_no="bigint": F.struct(
            F.lit(kind).alias("kind"),
            *[(null(v) if isinstance(v, str) else v).alias(k) for k, v in (("token", token), ("node", node), ("n", n), ("shingles", shingles), ("sha", sha), ("file_no", file_no))],
        )
        node, n = F.col("node"), F.col("n")
        own = [row("sets", node=node, n=n, shingles=F.col("shingles"))]
        own += [row("holders", node=node, sha=F.col("sha"), file_no=node)] if holders is None else []
        rows = F.concat(F.array(*own), F.transform("prefix", lambda t: row("postings", token=t, node=node, n=n)))
        out = texts.select(F.explode(rows).alias("r")).select("r.*")
        if holders is not None:
            out = out.unionByName(holders.select(row("holders", node=node, sha=F.col("sha"), file_no=F.col("file_no")).alias("r")).select("r.*"))
        by = F.when(F.col("kind") == "postings", self._bucket("token")).when(F.col("kind") == "sets", self._bucket("node")).otherwise(self._bucket("sha"))
        part = f"part=p{uuid.uuid4().hex[:8]}"
        out = out.withColumn("bucket", by).repartitionById(self._state["buckets"], "bucket").sortWithinPartitions("kind", "bucket", "token")
        out.write.option("compression", "lz4").option("maxRecordsPerFile", 5_000_000).partitionBy("kind", "bucket").parquet(f"{self.path}/{part}")
        self._swap([*self._state["parts"], part])
        if len(self._state["parts"]) > PARTS:
            self.compact()

    def _swap(self, parts: list[str]) -> None:
        state = self._state | {"parts": parts}
        self._pointer.swap(state)
        self._state = state

    def compact(self) -> None:
        """Put all parts together into one, so that the number of files follows the size and not the number of batches."""
        out = None
        for kind, names in self._columns.items():
            df = self.table(kind).select(F.lit(kind).alias("kind"), *names, self._bucket({"postings": "token", "sets": "node", "holders": "sha"}[kind]).alias("bucket"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        part = f"part=p{uuid.uuid4().hex[:8]}"
        out = out.select("kind", *[x.split()[0] for x in self._ddl.split(", ")], "bucket")
        out = out.repartitionById(self._state["buckets"], "bucket").sortWithinPartitions("kind", "bucket", "token")
        out.write.option("compression", "lz4").option("maxRecordsPerFile", 5_000_000).partitionBy("kind", "bucket").parquet(f"{self.path}/{part}")
        self._swap([part])

    def measure(self, texts: DataFrame, by: list[str] = ()) -> list:
        """(by, tokens, buckets) rows: of each batch the prefix tokens and the folders they are in, as many as there are at most."""
        own = texts.select(*by, F.explode_outer("prefix").alias("token"))
        return own.groupBy(*by).agg(F.count("token").alias("tokens"), F.collect_set(F.when(F.col("token").isNotNull(), self._bucket("token"))).alias("buckets")).collect()

    def probe(self, texts: DataFrame, tokens: int, buckets: list[int]) -> tuple[DataFrame, int]:
        """Matches of a batch's distinct texts, staged: (node, other, held), held if the other is in the index; and how
        many candidate pairs there were. Pairs within the batch come out once, node < other."""
        p, q = self.kind.least.numerator, self.kind.least.denominator
        own = texts.select("node", "n", F.explode("prefix").alias("token"))
        other = (
            self.table("postings", buckets)
            .select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.lit(True).alias("held"))
            .unionByName(own.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.lit(False).alias("held")))
        )
        fits = (F.col("n") * q >= F.col("m") * p) & (F.col("m") * q >= F.col("n") * p) & (F.col("held") | (F.col("node") < F.col("other")))
        if tokens <= self.small:
            met = other.join(F.broadcast(own), "token")
        else:
            hot = by_size(staged(own.groupBy("token").agg(F.ceil(F.count("*") / HOT).alias("parts")).where("parts > 1"), "hot-tokens"))
            dealt = own.join(hot, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            other = other.join(hot, "token", "left").withColumn("part", F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1)))).drop("parts")
            met = other.join(dealt, ["token", "part"])
        # Of the set whose prefix ends first, none of the prefix is in the other's rest: overlap <= met + own rest.
        least = F.ceil((F.col("n") + F.col("m")) * F.lit(p) / F.lit(p + q)) - F.ceil(F.greatest("n", "m") * F.lit(p) / F.lit(q)) + 1
        counted = Observation()
        met = met.where(fits).groupBy("node", "other", "held", "n", "m").agg(F.count("*").alias("met")).where(F.col("met") >= least)
        met = met.select("node", "other", "held").observe(counted, F.count("*").alias("n"))
        met = staged(met, "candidates")
        n = counted.get["n"]
        few = F.broadcast if n <= self.small else lambda df: df
        near = texts.select("node", "n", "shingles")
        y = self.table("sets").withColumn("held", F.lit(True)).unionByName(near.withColumn("held", F.lit(False)))
        y = y.select(F.col("node").alias("other"), F.col("n").alias("m"), F.col("shingles").alias("y"), "held")
        both = y.join(few(met), ["other", "held"]).join(near.withColumnRenamed("shingles", "x"), "node")
        both = both.where(self.kind.alike(F.size(F.array_intersect("x", "y")), F.col("n"), F.col("m"))).select("node", "other", "held")
        shas = texts.select("sha", "node")
        shas = F.broadcast(shas) if tokens <= self.small else shas
        equal = self.table("holders").select("sha", F.col("node").alias("other")).join(shas, "sha").select("node", "other", F.lit(True).alias("held"))
        equal = equal.distinct()  # a node once, however many files have its text
        return staged(both.unionByName(equal), "matches"), n

    def take(self, texts: DataFrame, tokens: int | None = None, buckets: list[int] = ()) -> DataFrame:
        """Take a batch, one row (sha, node, n, shingles, prefix) for each distinct text: append what is accepted, and
        return the matches found. tokens and buckets as from measure(), if that was done before."""
        if tokens is None:
            tokens, buckets = self.measure(texts)[0]
        matches, n = self.probe(texts, tokens, list(buckets))
        if n <= self.small:
            refused = F.broadcast(matches.coalesce(1).mapInArrow(_settled, "node long"))
        else:
            told = matches.where("held").select("node").distinct()
            open_ = matches.where("not held").join(told, "node", "left_anti").join(told.withColumnRenamed("node", "other"), "other", "left_anti")
            refused = told.unionByName(first_come(open_.select(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"))))
        self.append(texts.join(refused, "node", "left_anti"))
        return matches

    def refused(self, names: DataFrame, matches: DataFrame) -> DataFrame:
        """(file_no, node) of batches taken and the matches found for them -> (file_no, other_no) of the refused files.

        other_no is each file, accepted at that moment, that the refused file matches.
        """
        inside = matches.where("not held").select("node", "other")
        met = matches.where("held").select("node", "other", "held").unionByName(
            inside.unionByName(inside.select(F.col("other").alias("node"), F.col("node").alias("other"))).withColumn("held", F.lit(False))
        )
        met = met.unionByName(names.select("node", F.col("node").alias("other"), F.lit(False).alias("held")).distinct())
        accepted = self.table("holders").select(F.col("node").alias("other"), F.col("file_no").alias("other_no"))
        out = met.join(accepted, "other").join(names, "node").where("held or other_no < file_no")
        return out.select("file_no", "other_no").distinct()


def refused_files(files: DataFrame, manifest: DataFrame, path: str | None = None, small: int = BROADCAST_KEYS) -> DataFrame:
    """(file_no, other_no) for all batches after the history, taken one after the other.

    The batches' numbers are collected: one for each delivery. The texts of a batch are prepared with the order frozen
    on the history, whichever batch they come in, so this is done for all of them in one pass over the files.
    """
    spark = files.sparkSession
    texts = file_texts(files)
    listed = manifest.where("file_no is not null").select("file_no").distinct()
    texts = texts.join(listed.withColumn("listed", F.lit(True)), "file_no", "left")
    batch = F.when(F.col("listed") | (F.col("batch_no") < 0), F.least(F.col("batch_no"), F.lit(0))).otherwise(F.col("batch_no"))
    texts = staged(texts.withColumn("batch_no", F.when(batch < 0, 0).otherwise(batch).cast("int")).drop("listed"), "file-texts")
    nodes = texts.groupBy("batch_no", "sha").agg(F.min("file_no").alias("node"))
    names = texts.select("file_no", "batch_no", "sha").join(nodes, ["batch_no", "sha"])
    names = staged(names, "file-nodes")
    history = texts.where("batch_no = 0")
    _, common, shingles = survey(history.select(F.col("sha").alias("id"), F.col("text").alias("words")), KIND)
    index = HistoryIndex(spark, path, KIND, common, postings=int(shingles * (1 - KIND.least)), small=small)
    first_of = texts.join(nodes.select(F.col("node").alias("file_no"), F.col("node")), "file_no")
    ready = staged(index.prepare(first_of), "prepared-files", partition_by=["batch_no"])
    only_listed = (
        manifest.where("file_no is not null and sha256 is not null")
        .join(files.select("file_no").distinct(), "file_no", "left_anti")
        .select(F.lower(strip(F.col("sha256"))).alias("sha"), F.col("file_no").alias("node"), "file_no")
        .distinct()
    )
    index.append(ready.where("batch_no = 0"), names.where("batch_no = 0").select("sha", "node", "file_no").unionByName(only_listed))
    out = None
    for n, tokens, buckets in sorted(index.measure(ready.where("batch_no > 0"), ["batch_no"])):
        got = index.take(ready.where(F.col("batch_no") == n).drop("batch_no"), tokens, buckets)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "file_no long, other_no long")
    return index.refused(names.where("batch_no > 0").select("file_no", "node"), out)
