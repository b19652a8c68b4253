"""Access-audit signals and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import (
    band_from,
    hashed_id,
    quoted,
    signal_codes,
    weighted_score,
    with_expr,
)
from riskweave.settings import ACCESS_SIGNALS, ALERT_BANDS, ALERT_SCORE, BULK_ROWS, MAX_SCORE, Settings

ACCESS_INPUTS = (
    "access_event_id", "event_timestamp", "actor_id", "role_name", "rows_accessed",
    "privileged_access", "outside_business_hours", "source_sequence",
)
ACCESS_ORDER = ("source_sequence", *ACCESS_INPUTS[1:-1])


def access_flags(events: DataFrame) -> DataFrame:
    return with_expr(
        events,
        is_bulk_access=f"rows_accessed >= {BULK_ROWS}",
        is_privileged_after_hours="privileged_access AND outside_business_hours",
        _conformed_at="current_timestamp()",
    )


def access_signals(access: DataFrame) -> DataFrame:
    """Activity, score and reason codes per actor and role."""
    per_actor = access.groupBy("actor_id", "role_name").agg(
        F.expr("count(*) AS access_event_count"),
        F.expr("count_if(is_bulk_access) AS bulk_access_count"),
        F.expr("count_if(is_privileged_after_hours) AS privileged_after_hours_count"),
        F.expr("max(rows_accessed) AS maximum_rows_accessed"),
        F.expr("max(event_timestamp) AS last_access_at"),
    )
    return with_expr(
        per_actor,
        access_risk_score=weighted_score(ACCESS_SIGNALS, MAX_SCORE),
        reason_codes=signal_codes(ACCESS_SIGNALS),
        feature_calculated_at="current_timestamp()",
    )


def access_alerts(signals: DataFrame, settings: Settings) -> DataFrame:
    version = quoted(settings.policy_version)
    return with_expr(
        signals.filter(f"access_risk_score >= {ALERT_SCORE}"),
        alert_id=hashed_id("actor_id", "role_name", version),
        risk_level=band_from("access_risk_score", ALERT_BANDS, 1),
        recommended_action=band_from("access_risk_score", ALERT_BANDS, 2),
        policy_version=version,
        alerted_at="current_timestamp()",
    )
