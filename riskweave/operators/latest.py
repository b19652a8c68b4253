"""One row per key: deduplication and current state.

Both rank rows within a key and keep the first. Spark plans ``row_number() = 1`` as
a group limit before and after the shuffle, so a map task sends at most one row per
key and a key that holds a third of all rows costs its reducer one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANK = "_rank_in_key"


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], newest: bool = False
) -> DataFrame:
    """First (or newest) row of each key by ``order``, NULLs last. The other columns break
    ties, so a task that runs again after an executor is lost picks the same row."""
    ranked = [f"`{c}` {'DESC' if newest else 'ASC'} NULLS LAST" for c in order]
    rest = [f"`{c}`" for c in df.columns if c not in {*keys, *order}]
    window = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(ranked + rest)}"
    return (
        df.withColumn(_RANK, F.expr(f"row_number() OVER ({window})"))
        .filter(f"{_RANK} = 1")
        .drop(_RANK)
    )


def dedup_batch(df: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """One row per record id: the lowest by ``order_cols``."""
    return first_per_key(df, [key], order_cols)


def latest_changes(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Newest change per key, deletes included. Folding is associative, so partial
    results may be folded again in any order."""
    return first_per_key(df, keys, sequence, newest=True)


def current_state(
    df: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    delete_when: str,
    drop_cols: Sequence[str],
) -> DataFrame:
    """Current row per key from a change history (type 1): the newest change wins,
    a newest change that is a delete removes the key, NULLs overwrite."""
    newest = latest_changes(df, keys, sequence)
    return newest.filter(f"NOT coalesce({delete_when}, false)").drop(*drop_cols)


CUSTOMER_SEQUENCE = ("source_sequence", "change_timestamp", "change_id")


def current_customers(changes: DataFrame) -> DataFrame:
    return current_state(
        changes,
        ["customer_id"],
        CUSTOMER_SEQUENCE,
        "operation = 'DELETE'",
        ["operation", "change_id"],
    )
