"""Watermarked deduplication of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_arrival_split"


def dedup_stream(
    df: DataFrame, key: str, time_col: str, delay: str = "1 day", splits: int = 0
) -> DataFrame:
    """First arrival per record id. State for an id is dropped ``delay`` after its event
    time, and rows that come later than that are dropped, so state stays bounded.

    A stream cannot drop copies before its shuffle. When one record may make up a large
    part of a batch, ``splits`` first removes copies per id and reading task, which
    spreads that record over so many tasks; the second pass sees one row of each.
    """
    timed = df.withWatermark(time_col, delay)
    if splits:
        salted = timed.withColumn(_SALT, F.spark_partition_id() % splits)
        timed = salted.dropDuplicatesWithinWatermark([key, _SALT]).drop(_SALT)
    return timed.dropDuplicatesWithinWatermark([key])
