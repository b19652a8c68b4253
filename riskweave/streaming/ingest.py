"""Triggered incremental runs: process what has arrived, then stop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from riskweave.functions.conform import conform
from riskweave.operators.expectations import STATUS, tagged
from riskweave.sources.feeds import Feed


def run_available(
    df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> None:
    """Append everything that is available to a parquet table, once.

    The file sink's log makes a repeated batch invisible, so a lost executor or driver
    neither drops nor repeats rows as long as the checkpoint is kept.
    """
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path).awaitTermination()


def run_batches(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> None:
    """Hand each available micro-batch to ``handle(batch, batch_id)``."""
    (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def land_stream(raw: DataFrame, feed: Feed, source_name: str, path: str, checkpoint: str) -> None:
    """Bronze: conform a raw stream and land both outcomes with one read of the source."""
    run_available(tagged(conform(raw, feed, source_name), feed.rules), path, checkpoint, [STATUS])
