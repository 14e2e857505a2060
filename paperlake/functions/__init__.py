"""Column expressions for cleaning and comparing values; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row. A column that is named twice is worked out twice, so nested ones grow by powers of two."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_empty(c: Column) -> Column:
    """Null or the empty string."""
    return c.isNull() | (c == "")


def last_number(c: Column) -> Column:
    """The last number in a string, so that a date before it is passed over."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"([0-9][0-9,]*[.]?[0-9]*)"), F.lit(1)), F.lit(-1)).try_cast("decimal(12,2)")


def identity_fields(*cs: Column) -> Column:
    """How many of the columns hold something."""
    total = F.lit(0)
    for c in cs:
        total = total + (~is_empty(c)).cast("int")
    return total


#: One citation, and a marker of one or more.
CITATION = r"\s*[0-9]+\s*(?:→\s*Page\s*[0-9]+)?\s*"
MARKER = rf"\[({CITATION}(?:[;,]{CITATION})*)\]"


def strip_citations(c: Column) -> Column:
    """Without [n], [n → Page p] and grouped markers and bold marks, runs of spaces as one."""
    bare = F.regexp_replace(F.regexp_replace(c, MARKER, ""), r"\*\*", "")
    return F.trim(F.regexp_replace(bare, " {2,}", " "))

