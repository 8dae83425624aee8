"""Rate limits by key and window, for batches and streams, and the last use of each key."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, WINDOW_SECONDS = "15 minutes", 900
#: Requests in a window by bearer, and registrations and logins by address.
BEARER_LIMIT, LOGIN_LIMIT = 300, 20


def bearer(header: Column) -> Column:
    """The key that counts: the whole header if it is a bearer's, else null."""
    return F.when(F.startswith(header, F.lit("Bearer ")), header)


def windows(requests: DataFrame, key: str, ts: str = "ts", window: str = WINDOW, late: str | None = None) -> DataFrame:
    """Requests by key and tumbling window: ``key, start, n``. For a stream give ``late``, its watermark.

    The windows lie at fixed times of the day. Windows that begin with a key's first request are in ``anchored``.
    """
    rows = requests.withColumn("_at", F.col(ts).cast("timestamp")).where(F.col(key).isNotNull())
    if late:
        rows = rows.withWatermark("_at", late)
    counts = rows.groupBy(F.col(key), F.window("_at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), "n")


def exceeded(requests: DataFrame, key: str, limit: int, **how) -> DataFrame:
    return windows(requests, key, **how).where(F.col("n") > limit)


def anchored(requests: DataFrame, key: str, ts: str = "ts", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same for windows that begin with the first request of a key after its last window.

    Each key's times are sorted and read as a stream, of which a task holds one window.
    """
    kind = requests.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.TimestampType()), T.StructField("n", T.LongType())])
    own = "s" + uuid.uuid4().hex
    rows = requests.where(F.col(key).isNotNull()).select(F.col(key), F.unix_micros(F.col(ts).cast("timestamp")).alias(own)).where(F.col(own).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n = None, 0, 0
        for batch in itertools.chain(batches, [None]):
            keys, starts, counts = [], [], []
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, 0)]:
                if k == now and t < start + seconds * 1_000_000:
                    n += 1
                    continue
                if n:
                    keys.append(now)
                    starts.append(start)
                    counts.append(n)
                now, start, n = k, t, 1
            columns = [pa.array(keys, batch.schema.types[0]) if batch is not None else pa.array(keys), pa.array(starts, pa.timestamp("us", "UTC")), pa.array(counts, pa.int64())]
            if keys:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.repartition(key).sortWithinPartitions(key, own).mapInArrow(run, schema)


def last_used(uses: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return uses.groupBy(key).agg(F.max(ts).alias("last_used"))
