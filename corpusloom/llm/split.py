"""Problem 3: splitting oversized items at natural boundaries, by recursive bisection.

A stretch that is too long is cut at the strongest boundary near its midpoint (blank line, line end, sentence end; of
equally strong ones the nearest), else at the nearest boundary anywhere in it, and only where it has none at its
midpoint. Halves still above the limit less the overlap are cut again. Then each piece but the first gets the overlap
put before it, so that consecutive pieces share just that many characters (a piece shorter than the overlap is shared
as a whole).

Defined results: a record whose collection is null or not in run_identity has no limit and is no case; nor has one
whose max_chars is null or below 1. An overlap that is null, negative or not below max_chars counts as 0. Of several
limits for one collection the smallest counts. Rows of one id are one record (see record_rows). A null text counts as
''. Lengths and offsets count code points. Empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import record_rows

BOUNDARY = re.compile(r"\n|。|[.!?](?=\s)")
FORCED, SENTENCE, LINE, PARAGRAPH = range(4)


def boundaries(text: str) -> dict[int, list[int]]:
    """Places inside the text where it may be cut, by strength."""
    out: dict[int, list[int]] = {SENTENCE: [], LINE: [], PARAGRAPH: []}
    for m in BOUNDARY.finditer(text):
        at = m.end()
        if at < len(text):
            kind = SENTENCE if m[0] != "\n" else PARAGRAPH if m.start() and text[m.start() - 1] == "\n" else LINE
            out[kind].append(at)
    return out


def _nearest(places: list[int], lo: int, hi: int, mid: int) -> int | None:
    """Of the places in lo..hi the nearest to mid, the earlier of two."""
    i, j = bisect_left(places, lo), bisect_right(places, hi)
    k = bisect_left(places, mid, i, j)
    near = [places[x] for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda p: (abs(p - mid), p)) if near else None


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, end, strength of the cut at the end, whether it had to be forced), in order.

    The last piece's strength is PARAGRAPH: the text ends there. A cut had to be forced if it lies in a stretch of more
    than limit characters without a boundary inside.
    """
    places = boundaries(text)
    every = sorted(p for x in places.values() for p in x)
    cuts: list[tuple[int, int, bool]] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit if lo == 0 else limit - overlap):
            continue
        mid, reach = (lo + hi) // 2, (hi - lo) // 4
        at, kind = None, FORCED
        for kind in (PARAGRAPH, LINE, SENTENCE):
            at = _nearest(places[kind], max(lo + 1, mid - reach), min(hi - 1, mid + reach), mid)
            if at is not None:
                break
        if at is None:
            at = _nearest(every, lo + 1, hi - 1, mid)
            if at is not None:
                kind = next(k for k in (PARAGRAPH, LINE, SENTENCE) if _nearest(places[k], at, at, at) is not None)
        had_to = False
        if at is None:
            at, kind = mid, FORCED
            i = bisect_left(every, at)
            had_to = (every[i] if i < len(every) else len(text)) - (every[i - 1] if i else 0) > limit
        cuts.append((at, kind, had_to))
        todo += [(lo, at), (at, hi)]
    cuts.sort()
    out, start = [], 0
    for at, kind, had_to in [*cuts, (len(text), PARAGRAPH, False)]:
        out.append((max(0, start - overlap) if start else 0, at, kind, had_to))
        start = at
    return out


_SCHEMA = pa.schema(
    [
        ("id", pa.string()),
        ("source", pa.string()),
        ("heading", pa.string()),
        ("collection", pa.string()),
        ("chunk_index", pa.int32()),
        ("start", pa.int64()),
        ("text", pa.string()),
        ("cut", pa.string()),
        ("had_to_force", pa.bool_()),
    ]
)
_DDL = "id string, source string, heading string, collection string, chunk_index int, start long, text string, cut string, had_to_force boolean"


def _run(batches):
    names = ("forced", "sentence", "line", "paragraph")
    for b in batches:
        out = []
        for r in b.to_pylist():
            pieces = split(r["text"], r["max_chars"], r["overlap"])
            for i, (s, e, kind, had_to) in enumerate(pieces):
                cut = "end" if i == len(pieces) - 1 else names[kind]
                out.append((r["id"], r["source"], r["heading"], r["collection"], i, s, r["text"][s:e], cut, had_to))
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, x)) for x in out], _SCHEMA)
                    out = []
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, x)) for x in out], _SCHEMA)


def split_oversized(chunks: DataFrame, run_identity: DataFrame) -> DataFrame:
    """The pieces of every record longer than its collection's max_chars.

    (id, source, heading, collection, chunk_index, start, text, cut, had_to_force): chunk_index counts the pieces of a
    record from 0, start is the piece's offset in the record's text, cut says what its end is (paragraph, line,
    sentence, forced, or end of text).
    """
    overlap = F.col("overlap")
    limits = (
        run_identity.where("collection is not null and max_chars >= 1")
        .select("collection", F.struct("max_chars", F.when((overlap >= 0) & (overlap < F.col("max_chars")), overlap).otherwise(0).alias("overlap")).alias("x"))
        .groupBy("collection")
        .agg(F.min("x").alias("x"))
        .select("collection", "x.*")
    )
    rows = record_rows(chunks, keep=["collection", "source"])
    long = rows.join(limits, "collection").where(F.length("text") > F.col("max_chars"))
    long = long.dropDuplicates(["id"]).select("id", "source", "heading", "collection", "text", "max_chars", "overlap")
    return long.mapInArrow(_run, _DDL)
