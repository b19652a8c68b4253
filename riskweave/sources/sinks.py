"""Writes: append, append once, versioned overwrite, JSON lines, and the checked feedback log."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from riskweave.operators.expectations import STATUS, observed, observed_counts, quarantined, require, tagged
from riskweave.operators.feedback import FEEDBACK_RULES, FEEDBACK_SCHEMA
from riskweave.operators.latest import first_per_key
from riskweave.sources import manifest
from riskweave.sources.readers import FREED, options


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_partitioned(df: DataFrame, path: str, column: str) -> None:
    """Append clustered by a partition column. Rebalancing keeps the file count low and
    still splits a partition value that holds most of the rows."""
    append(df.hint("rebalance", column), path, [column])


BATCH = "batch_id"


def append_once(df: DataFrame, path: str, batch_id: str, partition_by: Sequence[str] = ()) -> bool:
    """Append the rows of a named batch unless the table has that batch; whether they were written.

    A batch is a folder of the table, and its success marker, which Spark writes last, is its entry
    in the log. A batch that did not end is not read and is written anew when it is sent again. One writer may
    send a batch at a time; different batches do not meet.
    """
    folder = f"{path}/{BATCH}={batch_id}"
    if manifest.finished(df.sparkSession, folder):
        return False
    with options(df.sparkSession, FREED):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    return True


def read_batches(spark: SparkSession, path: str, but: Sequence[str] = ()) -> DataFrame:
    """The rows of all finished batches of a table (``but`` those named), without their names."""
    found = [n for n in manifest.names(spark, path) if n.startswith(f"{BATCH}=") and n.partition("=")[2] not in but]
    done = [f"{path}/{n}" for n in found if manifest.finished(spark, f"{path}/{n}")]
    if not done:
        raise FileNotFoundError(f"no finished batch under {path}")
    return spark.read.option("basePath", path).option("mergeSchema", "false").parquet(*done).drop(BATCH)


def land(df: DataFrame, rules: dict[str, str], path: str, batch_id: str | None = None) -> None:
    """Append a conformed batch, accepted and quarantined rows apart, in one pass. With a batch id
    the batch lands once, however often it is sent; read it with ``read_batches``."""
    if batch_id is None:
        append(tagged(df, rules), path, [STATUS])
    else:
        append_once(tagged(df, rules), path, batch_id, [STATUS])


def land_counted(df: DataFrame, rules: dict[str, str], path: str) -> DataFrame:
    """``land``, and per rule the rows seen and the rows that break it, counted by the write itself:
    the source is read once. The counts are those of ``violation_counts``."""
    seen, counted = observed(df, rules)
    land(counted, rules, path)
    return observed_counts(df.sparkSession, rules, seen.get)


def replace(df: DataFrame, path: str) -> None:
    """Overwrite a table that the plan does not read. Parquet takes the new schema."""
    df.write.mode("overwrite").parquet(path)


def write_version(
    df: DataFrame, root: str, version: str, partition_by: str | None = None, keep: int = 3
) -> str:
    """Write a full refresh beside the old ones, then switch readers to it in one step.

    A version that readers may be on is never written again: a repeated one gets a folder of its own.
    The folders of the last ``keep`` switches stay for readers that began before; older ones go. A
    lower version than the current one is stored, but readers are not turned back to it.
    """
    spark = df.sparkSession
    path = f"{root}/version={version}"
    if manifest.exists(spark, path):
        path += f"~{os.urandom(4).hex()}"
    with options(spark, FREED):
        if partition_by:
            df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
        else:
            df.write.parquet(path)
    name = path.rpartition("/")[2]
    while True:
        now = manifest.current(spark, root)
        if now and _natural(now[1]["folder"]) > _natural(name):
            return path
        try:
            manifest.commit(spark, root, {"folder": name}, now[0] if now else 0)
            break
        except FileExistsError:
            continue
    held = {e["folder"] for e in manifest.retired(spark, root, keep)}
    for old in manifest.names(spark, root):
        # Unfinished folders may be another writer's.
        if old.startswith("version=") and old not in held and _natural(old) <= _natural(name) and manifest.finished(spark, f"{root}/{old}"):
            manifest.delete(spark, f"{root}/{old}")
    return path


def newest_version(spark: SparkSession, root: str) -> str:
    """Path of the version that the newest manifest names; of a table without manifests, the highest one
    that finished (it has its success marker). Numbers in a name count as numbers: 10 is after 9."""
    now = manifest.current(spark, root)
    if now:
        return f"{root}/{now[1]['folder']}"
    found = [n for n in manifest.names(spark, root) if n.startswith("version=")]
    done = [n for n in found if manifest.finished(spark, f"{root}/{n}")]
    if not done:
        raise FileNotFoundError(f"no finished version under {root}")
    return f"{root}/{max(done, key=_natural)}"


def _natural(name: str) -> list[tuple[int, int, str]]:
    """Sort key that takes runs of digits as numbers; what makes a repeated version's folder its own does not count."""
    parts = re.split(r"([0-9]+)", name.rsplit("=", 1)[1].partition("~")[0])
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in parts]


def read_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(newest_version(spark, root))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, keys in name order, absent values kept as null, times
    with their microseconds."""
    ordered = df.select(*[f"`{c}`" for c in sorted(df.columns)])
    ordered.write.mode("overwrite").options(
        ignoreNullFields="false", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)


def start_feedback(spark: SparkSession, path: str) -> None:
    """Make the feedback log, without rows, where there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        append(spark.createDataFrame([], FEEDBACK_SCHEMA), path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append reviewed outcomes; the whole batch fails when one row is not valid."""
    if set(df.columns) != set(FEEDBACK_SCHEMA.names):
        raise ValueError(f"feedback columns must be {FEEDBACK_SCHEMA.names}")
    append(require(df.select(*FEEDBACK_SCHEMA.names), FEEDBACK_RULES), path)


def append_feedback_once(df: DataFrame, path: str, batch_id: str) -> bool:
    """Append the outcomes of a named batch whose ids the log does not hold, each id once (the earliest by review
    time); whether the batch was new. The whole batch fails when one row is not valid. A batch that
    is sent again changes nothing, also when it did not end the first time. One writer at a time."""
    spark = df.sparkSession
    if set(df.columns) != set(FEEDBACK_SCHEMA.names):
        raise ValueError(f"feedback columns must be {FEEDBACK_SCHEMA.names}")
    new = first_per_key(require(df.select(*FEEDBACK_SCHEMA.names), FEEDBACK_RULES), ["feedback_id"], ["reviewed_at"])
    try:
        stored = read_batches(spark, path, but=[batch_id]).select("feedback_id")
        new = new.join(stored, "feedback_id", "left_anti").select(*FEEDBACK_SCHEMA.names)
    except FileNotFoundError:
        pass
    return append_once(new, path, batch_id)


def rejected_feedback(df: DataFrame) -> DataFrame:
    """The rows that would stop the append, with their reasons."""
    return quarantined(df, FEEDBACK_RULES)
