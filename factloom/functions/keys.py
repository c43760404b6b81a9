"""Keys and blanks: spelling of UUIDs, distinct strings, namespaced keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may stand around a key.
BLANKS = " \t\n\r\x0b\x0c\x85   　"
_HEX = r"([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})"
_UUID = rf"^(?:(?i:urn:uuid:))?{_HEX}$|^\{{{_HEX}\}}$"
_CANONICAL = "$1$6-$2$7-$3$8-$4$9-$5$10"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    return F.trim(as_column(x), F.lit(BLANKS))


def uuid_key(x: Column | str) -> Column:
    """One spelling for all that a UUID parser takes (upper case, no hyphens, braces, urn:uuid:, outer
    blanks); any other value stays as it is without outer blanks; null and blank give null."""
    x = as_column(x)
    t = trimmed(x)
    packed = F.regexp_replace(t, _UUID, _CANONICAL)
    # most keys are spelled so already: one look tells
    return F.when((F.length(x) == 36) & x.rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), x).when(F.length(t) == 0, None).otherwise(
        F.when(F.length(t).between(32, 45) & (F.length(packed) == 36), F.when(packed.rlike(rf"^{_HEX}$"), F.lower(packed)).otherwise(t)).otherwise(t)
    )


def scoped_key(scope: Column | str, key: Column | str) -> Column:
    """Scope (namespace) and key as one string; null where either is null."""
    return F.concat(as_column(scope), F.lit("\x1f"), as_column(key))


def distinct_strings(x: Column | str) -> Column:
    """Trimmed, non-empty, without repetition, in first order; null stays null."""
    return F.array_distinct(F.filter(F.transform(as_column(x), trimmed), lambda s: F.length(s) > 0))
