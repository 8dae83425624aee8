"""Deep pages without sorting the table: range counts find the few rows among which a page lies, and only these are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted for a page, about; ranges into which a pass cuts what is left.
FEW, RANGES = 100_000, 64


def _narrowed(rows: DataFrame, key: str, offset: int, size: int, total: int) -> tuple[int | None, int | None, int, int]:
    """``low, high, offset, total``: values ``low <= key < high`` (None: open) of the range that holds the page, what of the offset is left in it, and its rows."""
    cuts = rows.agg(F.percentile_approx(key, [(i + 1) / RANGES for i in range(RANGES - 1)], 20 * RANGES).alias("c")).first()["c"] or []
    # a value that many rows have gets a range of its own
    cuts = sorted({*cuts, *(c + 1 for c in cuts)})
    edges = list(zip([None, *cuts], [*cuts, None], strict=True))
    inside = lambda low, high: (F.lit(True) if low is None else F.col(key) >= low) & (F.lit(True) if high is None else F.col(key) < high)
    counts = rows.agg(*(F.count_if(inside(low, high)).alias(f"n{i}") for i, (low, high) in enumerate(edges))).first()
    before, first, last = 0, None, None
    for i, _ in enumerate(edges):
        after = before + counts[f"n{i}"]
        if first is None and after > offset:
            first, skipped = i, before
        if after >= min(offset + size, total):
            last = i
            break
        before = after
    if first is None or last is None:
        return None, None, offset, total
    held = sum(counts[f"n{i}"] for i in range(first, last + 1))
    return edges[first][0], edges[last][1], offset - skipped, held


def page(df: DataFrame, keys: list[Column], offset: int, size: int) -> DataFrame:
    """``size`` rows after ``offset``, in the order of ``keys``: whole numbers, of which null comes first, and the last of which tells rows apart.

    As long as many rows are left the range that holds the page is narrowed, by the first key and, within a value of it that
    many rows share, by the next. Every pass reads the keys alone.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    lowest = -(1 << 62)
    rows = df.withColumns({n: F.coalesce(k.cast("long"), F.lit(lowest)) for n, k in zip(names, keys, strict=True)})
    left, total = offset, rows.count()
    if offset >= total or size <= 0:
        return df.limit(0)
    for name in names:
        while total > FEW:
            low, high, left, held = _narrowed(rows, name, left, size, total)
            rows = rows.where((F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) < high))
            if held == total:
                break
            total = held
    return rows.orderBy(*names).offset(left).limit(size).drop(*names)


def by_date(events: DataFrame, number: int, size: int) -> DataFrame:
    """A page of events by start date (none first) and id."""
    return page(events, [F.unix_date("dateStart"), F.col("id")], (number - 1) * size, size)
