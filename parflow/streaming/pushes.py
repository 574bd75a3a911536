"""An extra: a stream of pushes (k, v, t) merged into a model store, one merge per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from parflow.plans.params import Store, last_write


def push_stream(stream: DataFrame, store: Store, checkpoint: str, pull: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **trigger):
    """Start the query; stop or await the returned handle."""

    def merge(batch: DataFrame, _: int) -> None:
        store.upsert(pull(batch, store.df) if pull else last_write(batch, "t"))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
