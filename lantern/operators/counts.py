"""Counts that are kept up to date: the signed changes of the rows that a command touched, added to what is stored, instead of a recount."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """How many rows pass ``test``, for each value of ``key`` (None: in all)."""

    name: str
    test: Column | None = None
    key: Column | None = None


def catalogue_kinds() -> list[Kind]:
    """All events, the public ones, the queue, and events by author and by category."""
    status = F.col("status")
    return [Kind("all"), Kind("public", status == "APPROVED"), Kind("queue", status == "PENDING"), Kind("author", key=F.col("createdById")), Kind("category", key=F.col("categoryId"))]


def _signed(rows: DataFrame, kinds: list[Kind], sign: int) -> DataFrame:
    """``kind, key, n``: a row for each kind that a row counts in, summed."""
    each = F.array(*(F.when(k.test if k.test is not None else F.lit(True), F.struct(F.lit(k.name).alias("kind"), (k.key if k.key is not None else F.lit(0)).cast("long").alias("key"))) for k in kinds))
    rows = rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*")
    return rows.groupBy("kind", "key").agg((F.count(F.lit(1)) * sign).alias("n"))


def counted(rows: DataFrame, kinds: list[Kind]) -> DataFrame:
    """``kind, key, n`` of all ``rows``, counted from nothing; what would be 0 has no row."""
    return _signed(rows, kinds, 1)


def change(before: DataFrame, after: DataFrame, ids: DataFrame, kinds: list[Kind], id: str = "id") -> DataFrame:
    """``kind, key, n``: by how much the counts of a table differ after the rows with ``ids`` were added, changed or deleted.

    Only these rows of the two snapshots are counted. ``ids`` may repeat, and may name rows that neither has.
    """
    touched = ids.select(F.col(id).alias("_id")).distinct()
    of = lambda rows: rows.join(touched, F.col(id) == F.col("_id"), "left_semi")
    both = _signed(of(before), kinds, -1).unionByName(_signed(of(after), kinds, 1))
    return both.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def kept(stored: DataFrame, *changes: DataFrame) -> DataFrame:
    """The stored counts after the changes."""
    for c in changes:
        stored = stored.unionByName(c)
    return stored.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def of(stored: DataFrame, kind: str, parents: DataFrame, id: str = "id", out: str = "count") -> DataFrame:
    """``parents`` with their stored count of a ``kind``, 0 included."""
    found = stored.where(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("n").alias("_n"))
    return parents.join(found, F.col(id) == F.col("_key"), "left").withColumn(out, F.coalesce("_n", F.lit(0))).drop("_key", "_n")
