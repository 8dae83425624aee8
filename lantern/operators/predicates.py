"""The search's predicates as Columns. Each takes the columns it tests, so it serves any table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions import text
from lantern.plans.params import Caller
from lantern.sources.schema import ROLES


def every(clauses: list[Column]) -> Column:
    return reduce(Column.__and__, clauses, F.lit(True))


def any_contains(columns: list[Column], q: str | Column) -> Column:
    return reduce(Column.__or__, (text.contains(c, q) for c in columns))


def affordable(is_free: Column, price: Column, most: float | Column) -> Column:
    """Free, or priced at no more than ``most``; an unknown price is not."""
    return is_free | (price.cast("double") <= F.lit(most).cast("double"))


def within_open(low: Column, high: Column, value) -> Column:
    """Between two bounds, of which a null one is open."""
    return (low.isNull() | (low <= value)) & (high.isNull() | (high >= value))


def ends_from(permanent: Column, end: Column, day) -> Column:
    return permanent | (end >= F.lit(day))


def starts_by(permanent: Column, start: Column, day) -> Column:
    return permanent | (start <= F.lit(day))


def widened(c: Column, value: str | Column, wide: str = "BOTH") -> Column:
    """Null, the value itself, or the value that stands for all."""
    return c.isNull() | (c == F.lit(value)) | (c == F.lit(wide))


def visible(status: Column, owner: Column, caller: Caller | None) -> Column:
    """Approved, one's own, or seen by a moderator."""
    if caller is None:
        return status == "APPROVED"
    return (status == "APPROVED") | (owner == caller.id) | F.lit(caller.has("MODERATOR"))


def changeable(owner: Column, caller: Caller) -> Column:
    return (owner == caller.id) | F.lit(caller.has("MODERATOR"))


def level(role: Column, levels: tuple[str, ...] = ROLES) -> Column:
    """The rank of a role, null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), role).cast("int"), F.lit(0)) - 1


def at_most(role: Column, caller: Caller) -> Column:
    return level(role) <= caller.level


def active(revoked_at: Column) -> Column:
    return revoked_at.isNull()
