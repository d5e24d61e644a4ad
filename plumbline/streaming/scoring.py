"""Arriving queries scored against a static index, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.operators import bm25


def score_arrivals(stream: DataFrame, postings: DataFrame, item_id: str, query_id: str, text: Column, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that gives sink the k best items of each micro-batch's queries.

    The index is a table, read by each batch; the checkpoint and an idempotent sink (keyed by batch number) make the
    results exactly-once.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = bm25.scores(postings, item_id, batch, query_id, text)
        sink(bm25.topk(found, query_id, item_id, "bm25", k), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
