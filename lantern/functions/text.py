"""Text semantics of the catalogue's collation: case and accents do not matter, trailing spaces neither in equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTAINS, EQUALS = "UNICODE_CI_AI", "UNICODE_CI_AI_RTRIM"


def contains(c: Column, q: str | Column, accent_sensitive: bool = False) -> Column:
    """Whether ``q``, taken literally, is in ``c``."""
    if accent_sensitive:
        return F.contains(F.collate(c, "UTF8_LCASE"), F.collate(F.lit(q), "UTF8_LCASE"))
    return F.contains(F.collate(c, CONTAINS), F.collate(F.lit(q), CONTAINS))


def same(a: Column, b: Column) -> Column:
    return F.collate(a, EQUALS) == F.collate(b, EQUALS)


def by_name(c: str) -> Column:
    return F.collate(c, CONTAINS)


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, "^[\\s\\p{Z}\\uFEFF]+|[\\s\\p{Z}\\uFEFF]+$", "")
