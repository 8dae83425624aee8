"""Streams, committed snapshots and kept counts over the driver's tables, each with its SQL.

A stream's query runs the stream to the end of what its source holds and returns the table that it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.catalogue import BASE_SQL, tables
from lantern.driver import Query
from lantern.operators import moderation
from lantern.plans.params import Refused
from lantern.sources import shared
from lantern.sources.commits import Snapshots
from lantern.streaming import limits, uses

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BASE_SQL}{sql}" if sql.startswith(",") else sql
        return f

    return add


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream, be it a file or a folder: a pattern serves for both."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


@query("""WITH RECURSIVE r AS (SELECT user_id, ts FROM events),
    s AS (SELECT user_id, min(ts) AS w FROM r GROUP BY 1 UNION ALL
        SELECT s.user_id, (SELECT min(r.ts) FROM r WHERE r.user_id = s.user_id AND r.ts >= s.w + INTERVAL 15 MINUTE) FROM s WHERE s.w IS NOT NULL)
    SELECT s.user_id, strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s JOIN r ON r.user_id = s.user_id AND r.ts >= s.w AND r.ts < s.w + INTERVAL 15 MINUTE
    WHERE s.w IS NOT NULL AND s.w + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def anchored_stream(spark, d):
    """Windows from a key's first request, of every request as a stream; those that the watermark has not passed are still open."""
    found = limits.drain(limits.anchored(streamed(spark, d, "events"), "user_id", "1 hour", request_id="event_id"), shared.workspace(spark))
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


@query(""", used AS (SELECT user_id % (SELECT count(*) FROM users) + 1 AS id, max(ts) AS last FROM events GROUP BY 1)
    SELECT k.id, k.name, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS "lastUsedAt", 1 AS version FROM keys k LEFT JOIN used USING (id)""")
def last_use_stream(spark, d):
    """Uses of keys as a stream whose sink commits each batch once, the second time not at all."""
    folder = shared.workspace(spark)
    base = tables(spark, d)
    store = Snapshots(spark, f"{folder}/catalogue")
    store.commit(None, {"api_keys": base["api_keys"]})
    n = base["users"].count()
    stream = streamed(spark, d, "events").select((F.col("user_id") % n + 1).cast("int").alias("id"), "ts")
    uses.follow(stream, store, f"{folder}/checkpoint")
    uses.follow(stream, store, f"{folder}/again")
    now = store.pinned()
    return now.tables["api_keys"].select("id", "name", F.date_format("lastUsedAt", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("lastUsedAt"), F.lit(now.version).alias("version"))


@query(""", m AS (SELECT id, CASE WHEN status <> 'PENDING' THEN status WHEN id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS status, status AS pinned FROM entries)
    SELECT m.*, 2 AS version, 1 AS conflicts, (SELECT count(*) FROM m WHERE status = 'APPROVED') AS total FROM m""")
def committed_moderation(spark, d):
    """Two moderators decide from one version: the second is refused, and decides anew what the first has left. A reader keeps its version."""
    base = tables(spark, d)
    store = Snapshots(spark, f"{shared.workspace(spark)}/catalogue")
    first = store.commit(None, {"events": base["events"]})

    def decided(view, action: str, which: str):
        queue = view.tables["events"].where("status = 'PENDING'").where(which)
        orders = queue.select(F.col("id").alias("eventId"), F.lit(1).alias("seq"), F.lit(action).alias("action"), F.lit(2).alias("actorId"), F.lit("MODERATOR").alias("actorRole"), F.lit("no").alias("reason"))
        return {"events": moderation.fold(view.tables["events"], orders).drop("applied", "refused")}

    store.commit(first, decided(first, "approve", "id % 2 = 0"))
    conflicts = 0
    try:
        store.commit(first, decided(first, "reject", "true"))
    except Refused:
        conflicts += 1
    last = store.apply(lambda view: decided(view, "reject", "true"))
    total = last.tables["events"].where("status = 'APPROVED'").agg(F.count(F.lit(1)).alias("total"))
    before = first.tables["events"].select("id", F.col("status").alias("pinned"))
    return last.tables["events"].select("id", "status").join(before, "id").crossJoin(total).select("*", F.lit(last.version).alias("version"), F.lit(conflicts).alias("conflicts"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
