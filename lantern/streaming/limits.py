"""Rate limits on a stream whose windows begin with a key's first request: keyed state with timers.

The batch of the same rule is ``ratelimit.anchored``; the stream gives the same rows for requests in any order within the watermark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lantern.streaming.ratelimit import WINDOW_SECONDS

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class AnchoredWindows(StatefulProcessor):
    """Of a key: the open window, and how many requests came at each time that the watermark has not passed yet.

    A request is folded into windows when nothing earlier can come any more, so their order of arrival does not matter. A window
    leaves, with its count, when the watermark passes its end; then the key holds nothing, and no state.
    """

    def __init__(self, key: str, seconds: int):
        self.key, self.length = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a list, as it is added to, read and replaced by one call for a key, not by some for each request
        self.waiting = handle.getListState("pending", "at long, n long")
        self.open = handle.getValueState("open", "start long, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = Counter(r["_at"] for r in rows)
        self.waiting.appendList(list(came.items()))
        # for what waits since before, the timer is set
        self._wake(min(came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        start, n = self.open.get() if self.open.exists() else (None, 0)
        done, due, rest = [], [], []
        for at, count in self.waiting.get():
            (due if at <= passed else rest).append((at, count))
        for at, count in sorted(due):
            if start is not None and at < start + self.length:
                n += count
                continue
            if start is not None:
                done.append((start, n))
            start, n = at, count
        if start is not None and start + self.length <= passed:
            done.append((start, n))
            start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update((start, n))
        if not rest:
            self.waiting.clear()
        elif due:
            self.waiting.put(rest)
        if rest or start is not None:
            self._wake(min([at for at, _ in rest] + ([start + self.length] if start is not None else [])), expiredTimerInfo.getExpiryTimeInMs())
        for begin, count in done:
            yield Row(**{self.key: key[0], "start": begin, "n": count})

    def _wake(self, micros: int, ringing: int | None = None) -> None:
        """The one timer of the key, at the first millisecond that is not before ``micros``, or sooner if it was. The ``ringing`` one is gone afterwards."""
        due = -(-micros // 1000)
        held = [timer for timer in self.handle.listTimers() if timer != ringing]
        if not held or due < min(held):
            for timer in held:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def anchored(requests: DataFrame, key: str, late: str, ts: str = "ts", request_id: str | None = None, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``key, start, n`` of every window of the stream ``requests``, once its end has passed the watermark ``late``.

    With ``request_id``, a request that is sent again within the watermark counts once. Rows without key or time do not count;
    those that come later than the watermark are dropped.
    """
    schema = T.StructType([T.StructField(key, requests.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
    rows = requests.withColumn("_time", F.col(ts).cast("timestamp")).where(F.col(key).isNotNull() & F.col("_time").isNotNull())
    rows = rows.withWatermark("_time", late)
    if request_id:
        rows = rows.dropDuplicatesWithinWatermark([request_id])
    rows = rows.select(key, "_time", F.unix_micros("_time").alias("_at"))
    requests.sparkSession.conf.set(*STORE)
    found = rows.groupBy(key).transformWithState(AnchoredWindows(key, seconds), schema, "Append", "EventTime")
    return found.withColumn("start", F.timestamp_micros("start"))


def drain(stream: DataFrame, folder: str, **options: str) -> DataFrame:
    """Run ``stream`` over all that its source holds now, from where the last run in ``folder`` ended, into a table there; the table so far."""
    writer = stream.writeStream.format("parquet").outputMode("append").options(**options)
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
