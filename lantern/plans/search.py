"""The search: filters, relations, order and page as one plan; and the other reads of the catalogue."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import geo, shape, text
from lantern.operators import predicates as p
from lantern.operators import relations as r
from lantern.plans.params import Caller, SearchParams

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Page:
    """``rows`` of one page; ``matches`` has all rows that the total counts, from the same input."""

    rows: DataFrame
    matches: DataFrame
    page: int
    page_size: int

    def total(self) -> int:
        return self.matches.count()

    def pages(self) -> int:
        return max(1, -(-self.total() // self.page_size))


def clauses(f: SearchParams, as_of: dt.date) -> list[Column]:
    """The active filters on events, but for the radius. Free suppresses the price cap; the period always counts."""
    c = F.col
    found = [c("status") == "APPROVED"]
    if f.q:
        found.append(p.any_contains([c("title"), c("description")], f.q))
    if f.free:
        found.append(c("isFree"))
    elif f.price_max is not None:
        found.append(p.affordable(c("isFree"), c("price"), f.price_max))
    if f.age is not None:
        found.append(p.within_open(c("ageMin"), c("ageMax"), f.age))
    found.append(p.ends_from(c("isPermanent"), c("dateEnd"), f.start or as_of))
    if f.end is not None:
        found.append(p.starts_by(c("isPermanent"), c("dateStart"), f.end))
    if f.setting is not None:
        found.append(p.widened(c("setting"), f.setting))
    if f.category_id is not None:
        found.append(c("categoryId") == f.category_id)
    return found


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def serialized(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"price": shape.number(F.col("price")), "dateStart": shape.day(F.col("dateStart")), "dateEnd": shape.day(F.col("dateEnd"))})


def search(tables: Tables, f: SearchParams, as_of: dt.date) -> Page:
    """Approved events that pass the filters, by start date (none first) and id, with venue, category and author.

    With a point and a radius the rows have ``distanceKm``, rounded; the filter takes the unrounded distance.
    """
    events = tables["events"].where(p.every(clauses(f, as_of)))
    if f.near:
        events = events.join(r.within(tables["venues"], *f.near), F.col("venueId") == F.col("_near")).drop("_near")
    # the page is cut before the relations are joined: these are to-one and required, so no row is lost or doubled
    order = lambda: [F.col("dateStart").asc_nulls_first(), F.col("id")]
    rows = r.with_relations(paged(events, order(), f.page, f.page_size), tables).orderBy(*order())
    rows = serialized(rows)
    if f.near:
        rows = rows.withColumn("distanceKm", geo.tenths(F.col("km"))).drop("km")
    return Page(rows, events, f.page, f.page_size)


def mine(tables: Tables, caller: Caller) -> DataFrame:
    own = tables["events"].where(F.col("createdById") == caller.id)
    return serialized(r.with_relations(own, tables)).orderBy(F.col("createdAt").desc(), F.col("id").desc())


def detail(tables: Tables, id: int, caller: Caller | None) -> DataFrame:
    """One row, or none if there is no such event or the caller may not see it."""
    one = tables["events"].where((F.col("id") == id) & p.visible(F.col("status"), F.col("createdById"), caller))
    return serialized(r.with_relations(one, tables))


def pending(tables: Tables, caller: Caller) -> DataFrame:
    """The queue, oldest first, with the authors' emails."""
    caller.need("MODERATOR")
    queue = tables["events"].where(F.col("status") == "PENDING")
    return serialized(r.with_relations(queue, tables, False, "email")).orderBy("createdAt", "id")


def users_with_counts(tables: Tables, caller: Caller) -> DataFrame:
    caller.need("ADMIN")
    users = tables["users"].select("id", "email", "displayName", "role", "createdAt")
    return r.counted(users, tables["events"], "createdById", "events").orderBy(F.col("createdAt").desc(), "id")


def categories(tables: Tables) -> DataFrame:
    return tables["categories"].orderBy(text.by_name("name"), "id")


def keys(tables: Tables, caller: Caller) -> DataFrame:
    caller.need("MODERATOR")
    users = tables["users"].select(F.col("id").alias("_user"), F.struct("id", "email", "displayName", "role").alias("user"))
    rows = tables["api_keys"].drop("keyHash").join(users, F.col("userId") == F.col("_user")).drop("_user", "userId")
    return rows.withColumn("state", shape.key_state(F.col("revokedAt"))).orderBy(F.col("createdAt").desc(), "id")


def assignable_users(tables: Tables, caller: Caller) -> DataFrame:
    """Accounts whose role is no higher than the caller's, by name."""
    caller.need("MODERATOR")
    users = tables["users"].where(p.at_most(F.col("role"), caller))
    return users.select("id", "email", "displayName", "role").orderBy(text.by_name("displayName"), "id")


def user_by_email(tables: Tables, email: str) -> DataFrame:
    return tables["users"].where(text.same(F.col("email"), F.lit(email)))


def identity(tables: Tables, key: str) -> DataFrame:
    """The account of an active key; none if the key is unknown or revoked."""
    hit = tables["api_keys"].where((F.col("keyHash") == shape.hashed(F.lit(key))) & p.active(F.col("revokedAt")))
    users = tables["users"].select(F.col("id").alias("_user"), "email", "displayName", "role")
    return hit.select(F.col("id").alias("keyId"), "userId").join(users, F.col("userId") == F.col("_user")).drop("_user")
