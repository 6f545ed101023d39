"""String helpers shared by every operator, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Drop leading and trailing whitespace, Unicode whitespace included."""
    return F.btrim(as_col(value), F.lit(WHITESPACE))


def count_occurrences(haystack: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    removed = F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)
