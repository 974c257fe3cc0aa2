"""Searching a static index with a stream of query rows: each micro-batch is one batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lumenvec.operators.exact import inverted


def search_stream(queries: DataFrame, vectors: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands the k best documents of each micro-batch's queries to `sink`, with the batch's number for exactly-once writes."""
    return queries.writeStream.foreachBatch(lambda batch, epoch: sink(inverted(batch, vectors, k), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
