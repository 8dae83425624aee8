"""The last use of each key as the sink of a stream: batches become versions of the keys, each once."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

from lantern.operators import mutations
from lantern.plans.params import Refused
from lantern.sources.commits import Snapshots


def sink(store: Snapshots, stream: str = "uses", tries: int = 3) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``id, ts``: sets ``lastUsedAt`` of ``api_keys`` to the latest use, in one commit a batch.

    The commit notes the batch's number, so a batch that is given again after a restart changes nothing; numbers
    belong to a checkpoint, so a new one needs a new name of the ``stream``. A batch that fails ``tries`` times is left out, with a warning: a use that is not noted must not stop requests.
    """

    def take(uses: DataFrame, batch: int) -> None:
        for left in reversed(range(tries)):
            try:
                base = store.pinned()
                if base.notes.get(stream, -1) >= batch:
                    return
                store.commit(base, {"api_keys": mutations.touched(base.tables["api_keys"], uses)}, {stream: batch})
                return
            except Refused:
                if not left:
                    logging.getLogger(__name__).warning("batch %s of %s lost against other writers", batch, stream)
            except Exception:
                if not left:
                    logging.getLogger(__name__).warning("batch %s of %s left out", batch, stream, exc_info=True)

    return take


def follow(uses: DataFrame, store: Snapshots, checkpoint: str, stream: str = "uses") -> None:
    """Take all that the source of the stream ``uses`` holds now, from where the last run with this ``checkpoint`` ended."""
    query = uses.writeStream.foreachBatch(sink(store, stream)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
