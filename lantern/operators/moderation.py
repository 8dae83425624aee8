"""Moderation as a state machine: one command as Columns, a batch of commands as spells between edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.predicates import level
from lantern.sources.schema import ROLES

MODERATOR = ROLES.index("MODERATOR")
STATE = "struct<status:string,rejectionReason:string,moderatedById:int,applied:int,refused:int>"


def step(state: Column, command: Column, owner: Column) -> Column:
    """The state after a command: ``action`` (approve, reject, edit), ``actorId``, ``actorRole``, ``reason``.

    Only moderators decide, and only what is pending. An edit by the author puts the event back in the queue
    and keeps who moderated it; one by a moderator changes nothing here; one by others is refused.
    """
    moderates = F.coalesce(level(command["actorRole"]) >= MODERATOR, F.lit(False))
    known = lambda test: F.coalesce(test, F.lit(False))  # noqa: E731  a command without an action or actor is refused
    decides = known(command["action"].isin("approve", "reject"))
    decision = decides & moderates & (state["status"] == "PENDING")
    edits, own = known(command["action"] == "edit"), known(command["actorId"] == owner)
    requeued = edits & ~moderates & own
    allowed = decision | (edits & (moderates | own))
    reject = command["action"] == "reject"
    return F.struct(
        F.when(decision, F.when(reject, "REJECTED").otherwise("APPROVED")).when(requeued, "PENDING").otherwise(state["status"]).alias("status"),
        F.when(decision, F.when(reject, command["reason"])).when(requeued, F.lit(None)).otherwise(state["rejectionReason"]).alias("rejectionReason"),
        F.when(decision, command["actorId"]).otherwise(state["moderatedById"]).cast("int").alias("moderatedById"),
        (state["applied"] + allowed.cast("int")).alias("applied"),
        (state["refused"] + (~allowed).cast("int")).alias("refused"),
    ).cast(STATE)


def fold(events: DataFrame, commands: DataFrame) -> DataFrame:
    """``events`` after ``commands`` (``eventId, seq, action, actorId, actorRole, reason``), with ``applied`` and ``refused``.

    The same as ``step`` by step, without gathering the commands of an event: each edit by the author begins a spell in which
    the event is pending, and the first decision of a pending spell is the one that counts. A running sum tells the spells;
    spells and events are then grouped. Commands of unknown events are ignored.
    """
    known = events.select(F.col("id").alias("_event"), F.col("createdById").alias("_owner"), (F.col("status") == "PENDING").alias("_pending"))
    rows = commands.join(known, F.col("eventId") == F.col("_event"))
    moderates = F.coalesce(level(F.col("actorRole")) >= MODERATOR, F.lit(False))
    edits = F.coalesce(F.col("action") == "edit", F.lit(False))
    own = edits & ~moderates & F.coalesce(F.col("actorId") == F.col("_owner"), F.lit(False))
    decides = F.coalesce(F.col("action").isin("approve", "reject"), F.lit(False)) & moderates
    entry = ["seq", "action", "actorId", "actorRole", "reason"]
    order = Window.partitionBy("_event").orderBy(*entry).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_own": own.cast("int"), "_edit": (own | (edits & moderates)).cast("int"), "_decides": decides})
    rows = rows.withColumn("_spell", F.sum("_own").over(order))
    spells = rows.groupBy("_event", "_spell").agg(
        F.first("_pending").alias("_pending"), F.count(F.lit(1)).alias("_n"), F.sum("_edit").alias("_edits"), F.min(F.when(F.col("_decides"), F.struct(*entry))).alias("_first"),
    )
    decided = F.when((F.col("_spell") > 0) | F.col("_pending"), F.col("_first"))
    spells = spells.withColumn("_first", decided)
    last = F.max(F.struct("_spell", "_first"))
    ends = spells.groupBy("_event").agg(
        last.alias("_last"), F.max(F.when(F.col("_first").isNotNull(), F.struct("_spell", F.col("_first.actorId").alias("actorId")))).alias("_by"),
        (F.sum("_edits") + F.count("_first")).cast("int").alias("_applied"), F.sum("_n").cast("int").alias("_n"),
    )
    rows = events.join(ends, F.col("id") == F.col("_event"), "left")
    first, requeued = F.col("_last._first"), F.coalesce(F.col("_last._spell") > 0, F.lit(False))
    reject = first["action"] == "reject"
    after = {
        "status": F.when(first.isNotNull(), F.when(reject, "REJECTED").otherwise("APPROVED")).when(requeued, "PENDING").otherwise(F.col("status")),
        "rejectionReason": F.when(first.isNotNull(), F.when(reject, first["reason"])).when(requeued, F.lit(None)).otherwise(F.col("rejectionReason")),
        "moderatedById": F.when(F.col("_by").isNotNull(), F.col("_by.actorId")).otherwise(F.col("moderatedById")).cast("int"),
    }
    applied = F.coalesce("_applied", F.lit(0))
    refused = F.coalesce(F.col("_n") - F.col("_applied"), F.lit(0)).cast("int")
    return rows.select(*(after[c].alias(c) if c in after else F.col(c) for c in events.columns), applied.alias("applied"), refused.alias("refused"))
