"""Typed projection of raw feed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.functions.columns import quoted
from riskweave.sources.feeds import Feed, Field

MALFORMED = "_malformed_columns"


def _typed(field: Field, have: str, as_sent: bool) -> str:
    value = field.name if have == field.type else f"try_cast({field.name} AS {field.type})"
    return f"upper({value}) AS {field.name}" if field.upper and not as_sent else f"{value} AS {field.name}"


def _can_fail(field: Field, have: str) -> bool:
    """Only casts to a non-text type that differs from the stored type can lose a value."""
    same_clock = field.type == "timestamp" and have == "timestamp_ntz"
    return field.type != "string" and have != field.type and not same_clock


def conform(df: DataFrame, feed: Feed, source_name: str, as_sent: bool = False) -> DataFrame:
    """Cast to the feed's types and stamp origin. Works on batch and streaming frames.
    ``as_sent`` leaves the letters' case alone, for checks of what a source may send.

    A value that does not fit its type becomes NULL instead of ending the job, and
    its column is named in ``_malformed_columns`` so that the row is quarantined
    even where no rule covers the column.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    malformed = [
        f"CASE WHEN {f.name} IS NOT NULL AND try_cast({f.name} AS {f.type}) IS NULL "
        f"THEN '{f.name}_malformed' END"
        for f in feed.fields
        if _can_fail(f, have[f.name])
    ]
    return df.selectExpr(
        *[_typed(f, have[f.name], as_sent) for f in feed.fields],
        f"{quoted(source_name)} AS _source_table",
        "current_timestamp() AS _ingested_at",
        f"concat_ws(',', {', '.join(malformed)}) AS {MALFORMED}" if malformed else f"'' AS {MALFORMED}",
    )
