"""Problem 6: filling containers of fixed capacity, by hierarchical residual packing.

Sizes are in tokens of a public tokenizer. A text longer than the capacity gives full containers of its own and one
remainder; everything else stays whole. Items are dealt out to parts of bounded size; each part is packed best-fit,
largest first, and its nearly full bins are final. The bins left over go up a tree as items: parts are merged, packed
again, and so on to one part. Where leftovers can't be merged (their number does not fall to what a part may hold),
packing stops with them as they are, so no task ever gets more than `part_items` items or so.

Defined results: a null or empty text has no tokens and is placed nowhere. Rows without doc_id are left out; a doc_id
that occurs more than once is one document, of differing texts the one with the most tokens counts. Equal sizes are
ordered by doc_id and offset. A container with a null capacity or one below 1 holds nothing and is left out; containers
of one name and different capacities are containers of their own. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut into words before merging; fixed, a part of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PART_ITEMS = 20_000
NEARLY_FULL = 0.995
FAN_IN = 8
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken file, loaded once in a worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each document with at least one token."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    rows = documents.where("doc_id is not null and text <> ''").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For each item, in the order given, the bin it goes to; and the bins' free space.

    Each goes to the bin with the least space that it fits; bins with the same space are kept together, and the spaces
    in use are the bits of one number, so the search is a shift.
    """
    free: list[int] = []
    with_space: dict[int, list[int]] = {}
    spaces = 0
    out = []
    for s in sizes:
        above = spaces >> s
        if above:
            space = s + (above & -above).bit_length() - 1
            bins = with_space[space]
            i = bins.pop()
            if not bins:
                spaces ^= 1 << space
        else:
            space, i = capacity, len(free)
            free.append(capacity)
        free[i] = space = space - s
        if space:
            with_space.setdefault(space, []).append(i)
            spaces |= 1 << space
        out.append(i)
    return out, free


CONTENT = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
_ITEM = "container string, capacity int, part int, size long, content array<struct<doc_id: long, start: long, n_tokens: long>>"


def _pack(full: float):
    """One part's items -> its bins; `done` if nearly full."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        capacity = table.column("capacity")[0].as_py()
        content = table.column("content").combine_chunks()
        sizes = table.column("size").to_numpy()
        heads = content.values.take(content.offsets[:-1])
        first, start = pc.struct_field(heads, "doc_id").to_numpy(), pc.struct_field(heads, "start").to_numpy()
        order = np.lexsort((start, first, -sizes))
        bins, free = best_fit(sizes[order].tolist(), capacity)
        bins, free = np.array(bins), np.array(free)
        by_bin = np.argsort(bins, kind="stable")
        taken = content.take(pa.array(order[by_bin]))
        lengths = np.diff(taken.offsets.to_numpy())
        per_bin = np.bincount(bins[by_bin], weights=lengths, minlength=len(free)).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(per_bin))).astype(np.int32)
        k = len(free)
        return pa.table(
            {
                "container": pa.array([table.column("container")[0].as_py()] * k, pa.string()),
                "capacity": pa.array(np.full(k, capacity, np.int32)),
                "part": pa.array(np.full(k, table.column("part")[0].as_py(), np.int32)),
                "size": pa.array(capacity - free),
                "content": pa.ListArray.from_arrays(pa.array(offsets), taken.flatten()).cast(CONTENT),
                "done": pa.array(free <= (1 - full) * capacity),
            }
        )

    return run


def pack(sizes: DataFrame, containers: DataFrame, *, part_items: int = PART_ITEMS, nearly_full: float = NEARLY_FULL, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, tokens) and (container, capacity) -> the content of every bin.

    (container, capacity, bin_id, doc_id, start, n_tokens): tokens start..start+n_tokens of the document lie in the bin.
    """
    kinds = containers.where("capacity >= 1 and container is not null").select("container", "capacity").distinct()
    listed = sorted((r[0], int(r[1])) for r in kinds.collect())  # the kinds of containers: the query, a handful of rows
    kind = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("int").alias("capacity")) for c, n in listed])
    if not listed:
        ddl = "container string, capacity int, bin_id string, doc_id long, start long, n_tokens long"
        return sizes.sparkSession.createDataFrame([], ddl)
    each = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(kind).alias("k")).select("doc_id", "tokens", "k.*")
    whole = each.where("tokens >= capacity").select(
        "container", "capacity", "doc_id", F.explode(F.expr("sequence(0L, tokens - capacity, cast(capacity as bigint))")).alias("start"), F.col("capacity").cast("long").alias("n_tokens")
    )
    rest = each.withColumn("size", F.expr("tokens % capacity")).where("size > 0")
    names = ["container", "capacity"]

    def counts(df: DataFrame) -> dict:
        return {(r[0], r[1]): r[2] for r in df.groupBy(*names).count().collect()}  # a row for each container

    def dealt(df: DataFrame, parts: dict, by) -> DataFrame:
        table = df.sparkSession.createDataFrame([(*k, p) for k, p in parts.items()], "container string, capacity int, parts int")
        return df.join(F.broadcast(table), names).withColumn("part", F.pmod(by, F.col("parts")).cast("int")).drop("parts")

    left = counts(rest)
    parts = {k: math.ceil(n / part_items) for k, n in left.items()}
    content = F.array(F.struct("doc_id", F.expr("tokens - size").alias("start"), F.col("size").alias("n_tokens")))
    if not parts:
        packed = None
    else:
        items = dealt(rest, parts, F.xxhash64("doc_id")).withColumn("content", content)
        final = []
        while True:
            bins = items.select("container", "capacity", "part", "size", "content").groupBy(*names, "part").applyInArrow(_pack(nearly_full), _ITEM + ", done boolean")
            bins = staged(bins, "bins")
            open_ = bins.where("not done")
            left = counts(open_)
            wider = {k: max(math.ceil(parts[k] / fan_in), math.ceil(n / part_items)) for k, n in left.items()}
            again = {k: p for k, p in wider.items() if p < parts[k]}
            marks = bins.sparkSession.createDataFrame([(*k, True) for k in again], "container string, capacity int, again boolean")
            bins = bins.join(F.broadcast(marks), names, "left")
            final.append(bins.where("done or again is null").select(*names, "content"))
            if not again:
                break
            # What the parts left over goes up to their parents, each that of the same number of neighbouring parts or so.
            old = bins.sparkSession.createDataFrame([(*k, parts[k]) for k in again], "container string, capacity int, old int")
            left_over = bins.where("not done and again").drop("again").join(F.broadcast(old), names)
            parts = again
            items = dealt(left_over, parts, F.floor(F.col("part") * F.col("parts") / F.col("old"))).drop("old")
        packed = final[0]
        for x in final[1:]:
            packed = packed.unionByName(x)
        packed = packed.select(
            "container", "capacity", F.concat_ws(":", F.col("content")[0]["doc_id"], F.col("content")[0]["start"]).alias("bin_id"), F.explode("content").alias("x")
        ).select("container", "capacity", "bin_id", "x.*")
    out = whole.select("container", "capacity", F.concat_ws(":", "doc_id", "start").alias("bin_id"), "doc_id", "start", "n_tokens")
    return out if packed is None else out.unionByName(packed)


def packed_documents(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(staged(token_counts(documents, tokenizer), "token-counts"), containers)


def waste(packed: DataFrame) -> DataFrame:
    """For each container the bins used, the tokens in them, the least bins possible and the share left unused."""
    each = packed.groupBy("container", "capacity", "bin_id").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("n").alias("tokens"))
    return total.select(
        "*",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"),
        F.round(1 - F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("unused"),
    )
