"""Table scans."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskweave.operators.expectations import ACCEPTED, QUARANTINED, REASONS, STATUS, side
from riskweave.sources import manifest
from riskweave.sources.feeds import Feed


def table(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan of a parquet table."""
    return spark.read.parquet(path)


def stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Incremental scan of a parquet directory: each file is delivered once per checkpoint.

    Leave ``maxFilesPerTrigger`` unset for a back-fill. The watermark then moves only
    after the whole first batch, so old rows in it are not late.
    """
    return spark.readStream.schema(schema).options(**options).parquet(path)


def accepted_table(spark: SparkSession, path: str) -> DataFrame:
    """Accepted side of a landed feed; the other side's files are pruned."""
    return side(spark.read.parquet(path), ACCEPTED)


def accepted_stream(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """Incremental scan of the accepted side. It starts from the table's root, so files of
    a write that did not finish are not seen. The schema is the feed's, so a feed may have
    no landed row yet."""
    stamps = f"_source_table string, _ingested_at timestamp, {REASONS} string, _quarantined_at timestamp, {STATUS} string"
    schema = T.StructType(feed.schema.fields + T.StructType.fromDDL(stamps).fields)
    return side(stream(spark, folder(spark, path), schema), ACCEPTED)


def quarantine_table(spark: SparkSession, path: str) -> DataFrame:
    return side(spark.read.parquet(path), QUARANTINED)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` where the session names one,
    otherwise a folder of the warehouse. On a cluster the warehouse must not be a local path then:
    an executor would not find what another one wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not _one_machine(spark.conf.get("spark.master", "local")) and _local_path(warehouse):
        raise ValueError(f"set spark.checkpoint.dir to shared storage: {warehouse} may be local to a machine")
    return f"{warehouse}/_shared"


def _one_machine(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def _local_path(path: str) -> bool:
    return path.startswith("file:")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"


#: Options of a write whose shuffle files go as soon as it has ended.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A table for this run alone: times are stored as they are, in 8 bytes, whatever the session prefers.
OWN_TABLE = {
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}
KEPT = "kept"


@contextmanager
def options(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these options, which are put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def kept(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """The frame computed once and stored as a table in the shared folder, for a plan that reads
    it several times: columns are still pruned, and the files outlive their executors. Shuffle files
    behind it go as soon as it is written. Files hold ``rows_per_file`` rows at most (0: as they come)."""
    path = fresh_path(df.sparkSession, KEPT)
    with options(df.sparkSession, FREED | OWN_TABLE):
        df.write.options(compression="zstd", maxRecordsPerFile=rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the ``kept`` tables that a frame reads, when nothing reads them any more."""
    for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if place.rpartition("/")[2].startswith(f"{KEPT}-"):
            manifest.delete(df.sparkSession, place)


def folder(spark: SparkSession, path: str) -> str:
    """The path, made if there is nothing yet, so that a stream can start on it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return path
