"""Commands of the catalogue: checks on a few rows by the caller's rights, then the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text
from lantern.operators import moderation
from lantern.operators import mutations as m
from lantern.operators.predicates import level
from lantern.operators.relations import used
from lantern.plans.params import Caller, Refused
from lantern.sources.schema import ROLES, inline

Tables = dict[str, DataFrame]


def _one(df: DataFrame, id: int):
    row = df.where(F.col("id") == id).first()
    if row is None:
        raise Refused(404)
    return row


def _own(tables: Tables, id: int, caller: Caller):
    row = _one(tables["events"], id)
    if row["createdById"] != caller.id and not caller.has("MODERATOR"):
        raise Refused(403)
    return row


def create(tables: Tables, events: DataFrame, caller: Caller, now: Column) -> Tables:
    """Adds valid ``events`` (with a ``venue`` struct) as pending ones of the caller; venues are reused or created."""
    fields = tables["venues"].columns[1:]
    flat = events.drop("id").select("*", *(F.col(f"venue.{f}").alias(f) for f in fields)).drop("venue")
    venues, rows = m.get_or_create(tables["venues"], flat)
    own = [c for c in rows.columns if c not in fields]
    rows = rows.select(*own).withColumns({"status": F.lit("PENDING"), "createdById": F.lit(caller.id), "createdAt": now, "rejectionReason": F.lit(None).cast("string"), "moderatedById": F.lit(None).cast("int")})
    rows = m.next_ids(m.normal(rows), tables["events"], ["title", "venueId"])
    return tables | {"venues": venues, "events": m.inserted(tables["events"], rows)}


def edit(tables: Tables, id: int, changes: DataFrame, caller: Caller) -> Tables:
    """Sets the columns of ``changes`` (one row); the author's own edit goes back to the queue."""
    _own(tables, id, caller)
    changes = changes.withColumn("id", F.lit(id))
    if not caller.has("MODERATOR"):
        changes = changes.withColumns({"status": F.lit("PENDING"), "rejectionReason": F.lit(None).cast("string")})
    return tables | {"events": m.normal(m.updated(tables["events"], changes))}


def delete(tables: Tables, id: int, caller: Caller) -> Tables:
    _own(tables, id, caller)
    return tables | {"events": tables["events"].where(F.col("id") != id)}


def moderate(tables: Tables, id: int, action: str, caller: Caller, reason: str | None = None) -> Tables:
    caller.need("MODERATOR")
    if _one(tables["events"], id)["status"] != "PENDING":
        raise Refused(409)
    events = tables["events"]
    command = events.sparkSession.createDataFrame([(id, 1, action, caller.id, caller.role, reason)], "eventId int, seq int, action string, actorId int, actorRole string, reason string")
    return tables | {"events": moderation.fold(events, command).drop("applied", "refused")}


def role_refusal(actor: Column, actor_role: Column, target: Column, role: Column) -> Column:
    """The code with which a change of a role is refused, of a whole table of them; null if it is allowed."""
    admin = F.coalesce(level(actor_role) >= ROLES.index("ADMIN"), F.lit(False))
    return F.when(~admin, 403).when(~F.coalesce(role.isin(*ROLES), F.lit(False)) | (target == actor), 400)


def set_role(tables: Tables, id: int, role: str, caller: Caller) -> Tables:
    """Nobody changes their own role."""
    caller.need("ADMIN")
    if role not in ROLES or id == caller.id:
        raise Refused(400)
    _one(tables["users"], id)
    return tables | {"users": tables["users"].withColumn("role", F.when(F.col("id") == id, role).otherwise(F.col("role")))}


def save_category(tables: Tables, name: str, caller: Caller, now: Column, id: int | None = None) -> Tables:
    """Adds a category, or renames one; a name that another has is a conflict."""
    caller.need("ADMIN")
    rows = tables["categories"]
    if id is not None:
        _one(rows, id)
    taken = rows.where(text.same(F.col("name"), F.lit(name)) & (F.lit(True) if id is None else F.col("id") != id))
    if not taken.isEmpty():
        raise Refused(409)
    if id is not None:
        return tables | {"categories": rows.withColumn("name", F.when(F.col("id") == id, name).otherwise(F.col("name")))}
    new = rows.sparkSession.createDataFrame([(name,)], "name string").withColumn("createdAt", now)
    return tables | {"categories": m.inserted(rows, m.next_ids(new, rows, ["name"]))}


def delete_category(tables: Tables, id: int, caller: Caller) -> Tables:
    """Only one that no event has."""
    caller.need("ADMIN")
    rows = tables["categories"]
    _one(rows, id)
    if not used(rows.where(F.col("id") == id), tables["events"], "categoryId").isEmpty():
        raise Refused(409)
    return tables | {"categories": rows.where(F.col("id") != id)}


def issue(tables: Tables, name: str, user_id: int, key_hash: str, caller: Caller, now: Column) -> Tables:
    """A key for an account whose role is no higher than the caller's; only the hash of the key is stored."""
    caller.need("MODERATOR")
    target = _one(tables["users"], user_id)
    if not caller.has(target["role"]):
        raise Refused(403)
    rows = tables["api_keys"]
    new = rows.sparkSession.createDataFrame([(name, key_hash, user_id)], "name string, keyHash string, userId int").withColumn("createdAt", now)
    return tables | {"api_keys": m.inserted(rows, m.next_ids(new, rows, ["name"]))}


def revoke(tables: Tables, id: int, caller: Caller, now: Column) -> Tables:
    caller.need("MODERATOR")
    return tables | {"api_keys": m.revoked(tables["api_keys"], id, now)}


def seed(tables: Tables, categories: list[str], users: list[dict], now: Column) -> Tables:
    """Categories and users that are absent are added; those that are there stay as they are."""
    spark = tables["users"].sparkSession
    names = spark.createDataFrame([(c,) for c in categories], "name string").withColumn("createdAt", now)
    numbered = m.next_ids(names, tables["categories"], ["name"]).select(*tables["categories"].columns)
    people = m.insert_absent(tables["users"], inline(spark, "users", users), "email")
    return tables | {"categories": m.insert_absent(tables["categories"], numbered, "name"), "users": people}
