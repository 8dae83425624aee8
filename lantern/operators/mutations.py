"""Changes as functions from one snapshot of a table to the next; a caller writes it to a new path and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import text
from lantern.plans.params import Refused
from lantern.sources import shared


def normal(events: DataFrame) -> DataFrame:
    """Free events have no price, permanent ones no dates."""
    return events.withColumns({
        "price": F.when(~F.col("isFree"), F.col("price")),
        "dateStart": F.when(~F.col("isPermanent"), F.col("dateStart")),
        "dateEnd": F.when(~F.col("isPermanent"), F.col("dateEnd")),
    })


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """``changes`` has ``id`` (unique) and the columns that it sets, null included."""
    fields = [c for c in changes.columns if c != id]
    new = changes.select(F.col(id).alias("_id"), *(F.col(c).alias(f"_{c}") for c in fields))
    rows = table.join(new, F.col(id) == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return rows.select(*(F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns))


def deleted(table: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return table.join(ids.select(F.col(id).alias("_id")), F.col(id) == F.col("_id"), "left_anti")


def revoked(keys: DataFrame, id: int, now: Column) -> DataFrame:
    """Sets ``revokedAt`` once; the row stays. 404 if there is no such key, 409 if it is revoked already."""
    found = keys.where(F.col("id") == id).select("revokedAt").first()
    if found is None:
        raise Refused(404)
    if found["revokedAt"] is not None:
        raise Refused(409)
    return keys.withColumn("revokedAt", F.when(F.col("id") == id, now).otherwise(F.col("revokedAt")))


def touched(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """``lastUsedAt`` from a batch of ``id, ts``: the latest use, if it is later."""
    last = uses.groupBy(F.col("id").alias("_id")).agg(F.max("ts").alias("_ts"))
    rows = keys.join(last, F.col("id") == F.col("_id"), "left")
    return rows.withColumn("lastUsedAt", F.greatest("lastUsedAt", "_ts")).select(*keys.columns)


def insert_absent(table: DataFrame, rows: DataFrame, key: str, collated: bool = True) -> DataFrame:
    """The rows whose key the table lacks are added; those that have it change nothing. Of rows alike, one is added."""
    equal = (lambda c: F.collate(c, text.EQUALS)) if collated else (lambda c: c)
    known = table.select(equal(F.col(key)).alias("_key"))
    order = Window.partitionBy(equal(F.col(key))).orderBy(*rows.columns)
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return inserted(table, first.join(known, equal(F.col(key)) == F.col("_key"), "left_anti"))


#: Parts in which new rows are numbered.
ID_BUCKETS = 1024


def next_ids(rows: DataFrame, table: DataFrame, order: list[str], id: str = "id") -> DataFrame:
    """Ids after the largest of the table, without gaps, to ``rows``; their order tells nothing but ties.

    Rows are dealt by a hash into ``ID_BUCKETS``: these are numbered side by side, after a sum over their sizes. They are
    written before, so that sizes and numbers are of the same rows, computed once.
    """
    rows = shared.written(rows, shared.workspace(rows.sparkSession), "new")
    top = table.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(ID_BUCKETS)))
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row a bucket
    before = sizes.select(F.col("_bucket").alias("_of"), (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = dealt.withColumn("_number", number).join(before, F.col("_bucket") == F.col("_of")).crossJoin(top)
    return numbered.withColumn(id, (F.col("_top") + F.col("_before") + F.col("_number")).cast("int")).drop("_bucket", "_number", "_of", "_before", "_top")


VENUE_KEY = ("name", "address", "city")
#: Seeding looks a venue up by less.
SEED_KEY = ("name", "city")


def get_or_create(venues: DataFrame, wanted: DataFrame, key: tuple[str, ...] = VENUE_KEY) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of ``venues``, and ``wanted`` with ``venueId``.

    Of venues alike in ``key`` that of the smallest id is taken, with its own postal code and coordinates;
    of wanted ones alike that no venue fits, one is created.
    """
    alike = [F.collate(F.col(k), text.EQUALS).alias(f"_{k}") for k in key]
    names = [f"_{k}" for k in key]
    kept = venues.select("id", *alike).groupBy(*names).agg(F.min("id").alias("_found"))
    wanted = shared.written(wanted, shared.workspace(wanted.sparkSession), "wanted")
    asked = wanted.select(*wanted.columns, *alike)
    order = Window.partitionBy(*names).orderBy(*(c for c in venues.columns if c != "id"))
    missing = asked.join(kept, names, "left_anti").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    fields = [c for c in venues.columns if c != "id"]
    created = next_ids(missing.select(*fields), venues, fields).select(*venues.columns)
    after = venues.unionByName(created)
    # a name that venues have keeps its smallest id, so only those that were created are new
    ids = kept.withColumnRenamed("_found", "venueId").unionByName(created.select(F.col("id").alias("venueId"), *alike))
    return after, asked.join(ids, names, "left").drop(*names)
