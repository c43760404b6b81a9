"""Text of facts: normal form, fingerprint, short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.keys import as_column


def normalised(x: Column | str) -> Column:
    """Lower case; only letters, decimal digits and single blanks between words; null gives an empty string."""
    low = F.lower(F.translate(F.coalesce(as_column(x), F.lit("")), "Σ", "σ"))
    kept = F.regexp_replace(low, r"[^\p{L}\p{Nd}\p{IsWhite_Space}]+", "")
    return F.trim(F.regexp_replace(kept, r"\p{IsWhite_Space}+", " "))


def hashed_uuid(*parts: Column | str) -> Column:
    """A UUID that depends on the parts only: of the SHA-256 of their texts, null as an empty one."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(as_column(x).cast("string"), F.lit("")) for x in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def idempotency_key(*parts: Column | str) -> Column:
    """One key for requests that are the same in all parts: the SHA-256 of their texts, each ended by a zero byte."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(as_column(x).cast("string"), F.lit("")), F.lit("\0")) for x in parts]), 256)


def shortened(x: Column | str, chars: int) -> Column:
    """The text, or its first characters and an ellipsis."""
    c = as_column(x)
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def node_text(text: Column | str, content: Column | str) -> Column:
    """What a node says: its text, else its content, else nothing."""
    return F.coalesce(F.nullif(as_column(text), F.lit("")), as_column(content), F.lit(""))


def fingerprint(x: Column | str) -> Column:
    """SHA-256 (hex) of the normal form; empty where nothing is left."""
    n = normalised(x)
    return F.when(n == "", F.lit("")).otherwise(F.sha2(n, 256))
