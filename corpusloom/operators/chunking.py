"""Heading-scoped, overlapping chunks of markdown, as expressions on the row.

A text is split before each ATX heading, each section into windows, and the windows are numbered by one posexplode. No
line or section is ever a row of its own, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, is_blank, strip

MAX_CHARS, OVERLAP = 1000, 150
#: White space that may follow the # signs: what is left of it inside a line.
INLINE = r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"


def sections(text: Column) -> Column:
    """array<struct<heading, body>>: the non-blank sections, stripped; null heading before the first heading."""
    lines = F.concat(F.lit("\n"), F.regexp_replace(text, LINE_BREAK, "\n"))
    parts = F.split(lines, rf"\n(?=#{{1,6}}{INLINE})")

    def section(part: Column, i: Column) -> Column:
        first = F.substring_index(part, "\n", 1)
        rest = F.substring(part, F.length(first) + 1, F.length(part))
        heading = strip(F.regexp_extract(first, rf"^#{{1,6}}{INLINE}+(.*)$", 1))
        return F.struct(
            F.when(i > 0, heading).alias("heading"),
            strip(F.when(i > 0, rest).otherwise(part)).alias("body"),
        )

    return F.filter(F.transform(parts, section), lambda s: s["body"] != "")


def windows(body: Column, max_chars: int, overlap: int) -> Column:
    """array<string>: the body whole if it fits, else windows of max_chars with the overlap, up to the first that reaches its end."""
    step = max_chars - overlap
    n = F.when(F.length(body) <= max_chars, 1).otherwise(F.ceil((F.length(body) - max_chars) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(body, i * step + 1, F.lit(max_chars)))


def chunk(files: DataFrame, *, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Rows with a text -> their other columns with (chunk_index, heading, text), one row per chunk.

    Null and blank texts, and texts of headings alone, give no rows.
    """
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")
    keep = [c for c in files.columns if c != text]
    pieces = F.flatten(
        F.transform(
            sections(F.col(text)),
            lambda s: F.transform(windows(s["body"], max_chars, overlap), lambda w: F.struct(s["heading"].alias("heading"), w.alias("text"))),
        )
    )
    rows = files.where(~is_blank(F.col(text))).select(*keep, F.posexplode(pieces).alias("chunk_index", "piece_"))
    return rows.select(*keep, "chunk_index", F.col("piece_.heading").alias("heading"), F.col("piece_.text").alias("text"))
