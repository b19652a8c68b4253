"""Definitions of protected views that outlive the session.

A definition is a manifest beside the tables: the versioned table that the view is over, the ids that
become tokens, and the open columns. The namespace of the tokens is a secret and is not
stored; whoever opens the view gives it. A view opened again follows the table's current version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.operators.governance import OPEN_COLUMNS, TOKENS, protected
from riskweave.sources import manifest
from riskweave.sources.sinks import read_version


def save_view(spark: SparkSession, root: str, name: str, table: str) -> None:
    """Define the view ``name``, or define it anew, over the versioned table at ``table``."""
    content = {"table": table, "tokens": [list(t) for t in TOKENS], "columns": list(OPEN_COLUMNS)}
    while True:
        now = manifest.current(spark, f"{root}/{name}")
        if now and now[1] == content:
            return
        try:
            manifest.commit(spark, f"{root}/{name}", content, now[0] if now else 0)
            return
        except FileExistsError:
            continue


def open_view(spark: SparkSession, root: str, name: str, namespace: str) -> DataFrame:
    """Register the stored view ``name`` in this session and return its rows."""
    now = manifest.current(spark, f"{root}/{name}")
    if now is None:
        raise FileNotFoundError(f"no view {name} under {root}")
    held = now[1]
    protected(read_version(spark, held["table"]), namespace, held["tokens"], held["columns"]).createOrReplaceTempView(name)
    return spark.table(name)


def open_views(spark: SparkSession, root: str, namespace: str) -> list[str]:
    """Register all stored views, as a session does when it begins; their names."""
    found = [n for n in manifest.names(spark, root) if manifest.numbers(spark, f"{root}/{n}")]
    for name in found:
        open_view(spark, root, name, namespace)
    return found
