"""Rows that come behind the watermark, kept apart and counted instead of vanishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.sources import manifest
from riskweave.sources.readers import stream
from riskweave.sources.sinks import read_batches

LATE = "_late"


def route_late(path: str, time_col: str, delay: str = "1 day") -> Callable[[DataFrame, int], None]:
    """Batch handler that stores each micro-batch with its late rows apart, in one pass over it.

    A row is late if its time is more than ``delay`` before the newest time of the batches before its
    own: what a watermark of that delay would drop. Rows without a time are not late. A batch
    writes to a folder named by its id and the newest time goes into a manifest, so a repeated batch
    replaces itself and is judged by the same batches as the first time.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        known = [manifest.entry(spark, path, n) for n in manifest.numbers(spark, path)]
        newest = [e["newest"] for e in known if e["batch"] < batch_id and e["newest"] is not None]
        late = F.lit(False)
        if newest:
            mark = F.timestamp_micros(F.lit(max(newest))) - F.expr(f"INTERVAL {delay}")
            late = F.coalesce(F.col(time_col) < mark, F.lit(False))
        told = batch.observe(seen, F.max(F.unix_micros(time_col)).alias("newest"), F.expr("count(1)").alias("n"))
        told.withColumn(LATE, late.cast("int")).write.mode("overwrite").partitionBy(LATE).parquet(f"{path}/batch_id={batch_id}")
        if not any(e["batch"] >= batch_id for e in known):
            times = [t for t in (*newest, seen.get["newest"]) if t is not None]
            number = (manifest.numbers(spark, path) or [0])[-1]
            manifest.commit(spark, path, {"batch": batch_id, "newest": max(times, default=None)}, number)
            # The batch before is needed when this one is repeated.
            manifest.retired(spark, path, 2)

    return handle


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, of all batches."""
    return read_batches(spark, path).where(f"{LATE} = 1").drop(LATE)


def on_time_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Incremental scan of the others."""
    routed = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField(LATE, T.IntegerType())])
    return stream(spark, path, routed).where(f"{LATE} = 0").drop("batch_id", LATE)


def arrival_counts(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    """One row: ``accepted``, ``kept``, ``copies``, ``late``, where accepted = kept + copies + late."""
    came = read_batches(spark, path).selectExpr("1 AS accepted", "0 AS kept", f"{LATE} AS late")
    every = came.unionByName(kept.selectExpr("0 AS accepted", "1 AS kept", "0 AS late"))
    return every.agg(
        *[F.expr(f"coalesce(sum({n}), 0L) AS {n}") for n in ("accepted", "kept", "late")]
    ).selectExpr("accepted", "kept", "accepted - kept - late AS copies", "late")
