"""Which folders make up a table: numbered manifests, each written last and in one step.

A manifest is a small JSON file ``_manifest/<number>`` beside the folders that it names. It is written
under another name and then renamed, which fails where the number is taken, so of two
writers one has to start again. Readers follow the highest number: they see all of a change or
none. Folders go when none of the last few manifests names them, so a reader that planned its
scan before keeps its files for as many changes.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

FOLDER = "_manifest"


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    system, place = files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, place = files(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    system, place = files(spark, path)
    system.delete(place, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder ended: Spark leaves a marker last."""
    return exists(spark, f"{path}/_SUCCESS")


def numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in names(spark, f"{root}/{FOLDER}") if n.isdigit())


def entry(spark: SparkSession, root: str, number: int) -> dict:
    system, place = files(spark, f"{root}/{FOLDER}/{number:012d}")
    source = system.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def current(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """Number and content of the newest manifest; None where there is none."""
    known = numbers(spark, root)
    return (known[-1], entry(spark, root, known[-1])) if known else None


def commit(spark: SparkSession, root: str, content: dict, after: int) -> int:
    """Make ``content`` the manifest that follows number ``after`` (0: the first). FileExistsError if another
    writer was faster: read the newest manifest and start again from it."""
    folder = f"{root}/{FOLDER}"
    system, hidden = files(spark, f"{folder}/.{os.urandom(8).hex()}")
    out = system.create(hidden, False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    target = files(spark, f"{folder}/{after + 1:012d}")[1]
    if system.exists(target) or not system.rename(hidden, target):
        system.delete(hidden, False)
        raise FileExistsError(f"{root} was changed by another writer")
    return after + 1


def retired(spark: SparkSession, root: str, keep: int) -> list[dict]:
    """Drop all but the newest ``keep`` manifests; what those hold that stay."""
    known = numbers(spark, root)
    for number in known[:-keep]:
        delete(spark, f"{root}/{FOLDER}/{number:012d}")
    return [entry(spark, root, number) for number in known[-keep:]]
