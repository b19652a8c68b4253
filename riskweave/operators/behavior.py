"""Behavioural features and score per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import signal_codes, weighted_score, with_expr
from riskweave.settings import BEHAVIOR_SIGNALS, HOME_COUNTRY, MAX_SCORE

# The columns the features need. Selecting them before deduplication keeps the
# shuffle narrow; a stored Silver table is written with all columns.
AUTH_INPUTS = (
    "auth_event_id", "event_timestamp", "customer_id", "device_id", "ip_address",
    "auth_result", "mfa_result", "user_agent", "source_sequence",
)
DEVICE_INPUTS = (
    "device_event_id", "observed_at", "customer_id", "device_id", "country",
    "is_vpn", "is_tor", "device_trust", "source_sequence",
)
# Which copy of a record is kept: lowest sequence, then earliest; then by what the features
# read, so that it does not matter which other columns a plan has.
AUTH_ORDER = ("source_sequence", *AUTH_INPUTS[1:-1])
OBSERVATION_ORDER = ("source_sequence", *DEVICE_INPUTS[1:-1])

COUNTS = (
    "authentication_count", "failed_login_count", "mfa_bypass_count", "headless_client_count",
    "authentication_device_count", "authentication_ip_count", "observed_device_count",
    "observed_country_count", "anonymized_network_count", "untrusted_device_count",
    "impossible_travel_count",
)


def auth_flags(events: DataFrame) -> DataFrame:
    return with_expr(
        events,
        is_failed_login="auth_result = 'FAILURE'",
        is_mfa_bypass="mfa_result = 'BYPASSED'",
        is_headless_client="contains(lower(user_agent), 'headless')",
        _conformed_at="current_timestamp()",
    )


def device_flags(events: DataFrame) -> DataFrame:
    return with_expr(
        events,
        is_anonymized_network="is_vpn OR is_tor",
        is_untrusted_device="device_trust <> 'TRUSTED'",
        _conformed_at="current_timestamp()",
    )


def auth_features(auth: DataFrame) -> DataFrame:
    return auth.groupBy("customer_id").agg(
        F.expr("count(*) AS authentication_count"),
        F.expr("count_if(is_failed_login) AS failed_login_count"),
        F.expr("count_if(is_mfa_bypass) AS mfa_bypass_count"),
        F.expr("count_if(is_headless_client) AS headless_client_count"),
        F.expr("count(DISTINCT device_id) AS authentication_device_count"),
        F.expr("count(DISTINCT ip_address) AS authentication_ip_count"),
        F.expr("max(event_timestamp) AS last_authentication_at"),
    )


def device_features(devices: DataFrame) -> DataFrame:
    return devices.groupBy("customer_id").agg(
        F.expr("count(DISTINCT device_id) AS observed_device_count"),
        F.expr("count(DISTINCT country) AS observed_country_count"),
        F.expr("count_if(is_anonymized_network) AS anonymized_network_count"),
        F.expr("count_if(is_untrusted_device) AS untrusted_device_count"),
        F.expr(f"count_if(upper(country) <> '{HOME_COUNTRY}') AS impossible_travel_count"),
        F.expr("max(observed_at) AS last_device_observation_at"),
    )


def behavioral_features(auth: DataFrame, devices: DataFrame) -> DataFrame:
    """Both feature sets on one row per customer, with score and reason codes.

    Both sides leave their aggregation partitioned by customer, so the full join adds
    no shuffle; each key has one row per side, so it cannot be skewed.
    """
    both = auth_features(auth).join(device_features(devices), "customer_id", "full")
    return with_expr(
        both.fillna(0, subset=list(COUNTS)),
        behavioral_risk_score=weighted_score(BEHAVIOR_SIGNALS, MAX_SCORE),
        reason_codes=signal_codes(BEHAVIOR_SIGNALS),
        feature_calculated_at="current_timestamp()",
    )
