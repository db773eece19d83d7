"""Incremental upserts from a stream of walk records: each micro-batch is merged into the store as one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources.store import Store


def follow(records: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """records: a streaming frame (path, size, mtime, format). Merging is idempotent, so a batch that is replayed after a
    failure leaves the same rows."""

    def merge_batch(batch: DataFrame, _: int) -> None:
        store.write("files", merge.upsert(store.read("files"), batch))

    writer = records.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
