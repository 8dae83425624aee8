"""Joins and counts between the tables. The optimizer picks the strategy; nothing here is broadcast by force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.functions import geo


def author(users: DataFrame, *more: str) -> DataFrame:
    """What others may see of a user; hashes are never selected."""
    return users.select(F.col("id").alias("_author"), F.struct("id", "displayName", *more).alias("createdBy"))


def place(venues: DataFrame) -> DataFrame:
    """Venues as one struct column, with their coordinates as numbers."""
    row = F.struct(*venues.columns)
    row = row.withField("lat", F.col("lat").cast("double")).withField("lng", F.col("lng").cast("double"))
    return venues.select(F.col("id").alias("_venue"), row.alias("venue"))


def within(venues: DataFrame, lat: float, lng: float, radius_km: float, *carried: str) -> DataFrame:
    """``_near, km`` (and ``carried``) of the venues in a radius, by their unrounded distance. The box only saves arcsines."""
    km = geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng)
    boxed = venues.where(geo.in_box(F.col("lat"), F.col("lng"), lat, lng, radius_km))
    return boxed.select(F.col("id").alias("_near"), km.alias("km"), *carried).where(F.col("km") <= radius_km)


def with_relations(events: DataFrame, tables: dict[str, DataFrame], category: bool = True, *author_fields: str) -> DataFrame:
    """Events with ``venue``, ``category`` and ``createdBy`` as structs."""
    rows = events.join(place(tables["venues"]), F.col("venueId") == F.col("_venue"))
    rows = rows.join(author(tables["users"], *author_fields), F.col("createdById") == F.col("_author"))
    if category:
        kinds = tables["categories"]
        rows = rows.join(kinds.select(F.col("id").alias("_category"), F.struct(*kinds.columns).alias("category")), F.col("categoryId") == F.col("_category"))
    return rows.drop("_venue", "_author", "_category")


def counted(parents: DataFrame, children: DataFrame, key: str, out: str = "count", id: str = "id") -> DataFrame:
    """``parents`` with the number of their ``children``, 0 included."""
    counts = children.groupBy(F.col(key).alias("_parent")).agg(F.count(F.lit(1)).alias(out))
    return parents.join(counts, F.col(id) == F.col("_parent"), "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_parent")


def used(parents: DataFrame, children: DataFrame, key: str, id: str = "id", yes: bool = True) -> DataFrame:
    """The parents that have children, or those that have none."""
    keys = children.select(F.col(key).alias("_parent"))
    return parents.join(keys, F.col(id) == F.col("_parent"), "left_semi" if yes else "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that more than one row has: what a unique key forbids."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, key: str, parents: DataFrame, id: str = "id") -> DataFrame:
    """Children whose key is set but has no parent: what a foreign key forbids."""
    known = parents.select(F.col(id).alias("_parent"))
    return children.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_parent"), "left_anti")
