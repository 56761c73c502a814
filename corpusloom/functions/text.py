"""Text primitives with Unicode semantics that Spark's own functions lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of str.strip() and of an unflagged \s, and the line breaks of str.splitlines().
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85\u2028\u2029]"

HEADING = rf"^#{{1,6}}[{WS}]+(.*)$"


def strip(c: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space strings."""
    return F.coalesce(~c.rlike(rf"[^{WS}]"), F.lit(True))


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def decode_utf8(content: Column) -> Column:
    """Strict UTF-8 with universal newlines; null for bytes that are not UTF-8. A byte-order mark is kept."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), universal_newlines(s))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def ascii_tokens(c: Column) -> Column:
    """Runs of [a-z0-9] in the lower-cased text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))
