"""Streams into tables (an addition: stored tables have no streams of their own)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lamina.sources.table import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, name: str = "stream", **trigger: object) -> StreamingQuery:
    """Append every micro-batch of a stream to a table.

    The last batch's number is part of the manifest that names the batch's files, so
    both are there or neither, and a batch that runs again after a failure is not
    appended twice. Streams into one table need names of their own.
    """
    writer = stream.writeStream.foreachBatch(batch_writer(table, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def batch_writer(table: Table, name: str) -> Callable[[DataFrame, int], None]:
    """What appends a numbered batch, once."""

    def add(batch: DataFrame, number: int) -> None:
        table.reload()
        if number > table.last_batch(name):
            table.append(batch, batch=(name, number))

    return add
