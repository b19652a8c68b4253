"""From a back-fill to a stream that knows what the back-fill has kept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.latest import dedup_batch
from riskweave.sources import manifest
from riskweave.sources.readers import folder, stream
from riskweave.sources.sinks import append_once, read_batches
from riskweave.streaming.dedup import dedup_stream
from riskweave.streaming.ingest import run_batches

#: Marks rows that are there for the stream's state alone.
SEED = "_seed"
BACKFILL = "backfill"


@dataclass(frozen=True)
class Handover:
    """One row per record, first of a back-fill in batch form and then of a stream.

    ``table`` takes the kept rows, batch by batch; read it with ``read_batches``. ``inbox`` takes the
    arrivals of the stream. The stream's first micro-batch holds only the kept rows of the last
    ``delay`` of the back-fill, whose ids become its state: not the ids of the whole history. Every
    step may be repeated.
    """

    table: str
    inbox: str
    checkpoint: str
    schema: T.StructType
    key: str
    time_col: str
    delay: str = "1 day"
    splits: int = 0

    def back_fill(self, rows: DataFrame, order: Sequence[str]) -> None:
        """Store one row per record of all that has come so far, the lowest by ``order``, and start the
        stream from the last of them."""
        append_once(dedup_batch(rows.select(*self.schema.names), self.key, order), self.table, BACKFILL)
        spark = rows.sparkSession
        stored = read_batches(spark, self.table)
        newest = stored.agg(F.max(self.time_col)).first()[0]
        recent = F.col(self.time_col) >= F.lit(newest) - F.expr(f"INTERVAL {self.delay}")
        append_once(stored.where(recent).withColumn(SEED, F.lit(True)), self.inbox, BACKFILL)
        self.run(spark)

    def arrive(self, rows: DataFrame, batch_id: str) -> bool:
        """Land rows that came after the back-fill, each batch once."""
        spark = rows.sparkSession
        if not manifest.finished(spark, f"{self.inbox}/batch_id={BACKFILL}"):
            raise ValueError("the back-fill has to end before rows arrive")
        if not manifest.exists(spark, f"{self.checkpoint}/commits/0"):
            self.run(spark)  # the seeds alone
        return append_once(rows.select(*self.schema.names).withColumn(SEED, F.lit(False)), self.inbox, batch_id)

    def run(self, spark: SparkSession) -> None:
        """Add what has arrived since the last run, less the records of the ``delay`` before. Rows later
        than that are left out, as in ``dedup_stream``."""
        seeded = T.StructType([*self.schema.fields, T.StructField(SEED, T.BooleanType())])
        rows = stream(spark, folder(spark, self.inbox), seeded, recursiveFileLookup="true")
        once = dedup_stream(rows, self.key, self.time_col, self.delay, self.splits).where(f"NOT {SEED}").drop(SEED)
        table = self.table
        run_batches(once, lambda batch, n: append_once(batch, table, f"stream-{n}"), self.checkpoint)
