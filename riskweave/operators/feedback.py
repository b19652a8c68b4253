"""Analyst feedback: an append-only log of reviewed outcomes."""

from __future__ import annotations

from pyspark.sql import types as T

from riskweave.functions.columns import one_of
from riskweave.settings import DISPOSITIONS

_REQUIRED = (
    "feedback_id", "transaction_id", "model_name", "model_version", "analyst_id", "disposition",
)

FEEDBACK_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in _REQUIRED]
    + [
        T.StructField("analyst_notes", T.StringType(), True),
        T.StructField("reviewed_at", T.TimestampType(), False),
        T.StructField("recorded_at", T.TimestampType(), False),
    ]
)

FEEDBACK_RULES = {
    f"{f.name}_required": f"{f.name} IS NOT NULL" for f in FEEDBACK_SCHEMA if not f.nullable
}
FEEDBACK_RULES["disposition_supported"] = one_of("disposition", DISPOSITIONS)
