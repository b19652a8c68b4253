"""Transaction decisions, cases and daily metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import NO_CODES, band_from, codes, hashed_id, one_of, quoted, with_expr
from riskweave.operators.expectations import require
from riskweave.settings import (
    AMOUNT_BANDS,
    DECISION_BANDS,
    HIGH_SEGMENT_POINTS,
    MAX_SCORE,
    REMOTE_CHANNEL_POINTS,
    REMOTE_CHANNELS,
    SHARED_DEVICE_POINTS,
    Settings,
)
from riskweave.sources.feeds import DECISION_GUARD
from riskweave.sources.rollups import Rollup

# --- Fixed values: columns of a decision and of a case
DECISION_COLUMNS = (
    "decision_id", "transaction_id", "event_id", "event_timestamp", "customer_id", "account_id",
    "merchant_id", "device_id", "amount", "currency", "payment_channel", "risk_score",
    "risk_level", "recommended_action", "reason_codes", "behavioral_risk_score",
    "linked_customer_count", "resolved_identity_id", "policy_version", "decisioned_at",
)
CASE_COLUMNS = (
    "case_id", "decision_id", "transaction_id", "customer_id", "event_timestamp", "risk_score",
    "risk_level", "recommended_action", "reason_codes", "case_priority", "case_status",
    "queue_name", "policy_version", "created_at",
)
# --- End of fixed values -----------------------------------------------------------

# What a decision, a model input and the device network need of a payment.
PAYMENT_INPUTS = (
    "event_id", "event_timestamp", "transaction_id", "customer_id", "account_id", "merchant_id",
    "device_id", "amount", "currency", "payment_channel", "source_sequence", "scenario_label",
)


def customer_profiles(customers: DataFrame, behavior: DataFrame) -> DataFrame:
    """Customer state and behaviour on one row per customer.

    Joined before payments so that payments meet the customer key in one join, which
    AQE can split at a hot customer because a shuffle by device follows it.
    """
    state = customers.select("customer_id", "risk_segment", "resolved_identity_id")
    return state.join(behavior.drop("feature_calculated_at"), "customer_id", "full")


def enrich(
    payments: DataFrame, customers: DataFrame, behavior: DataFrame, network: DataFrame
) -> DataFrame:
    """Payments with customer, behaviour and device features; every payment is kept.

    No join hint: the feature sides grow with customers and devices, so Spark
    broadcasts them only below its size limit and otherwise sorts and merges.
    """
    return with_features(payments, customer_profiles(customers, behavior), network)


def with_features(payments: DataFrame, profiles: DataFrame, network: DataFrame) -> DataFrame:
    """``enrich`` where the profiles of customers are there already."""
    devices = network.drop("network_feature_calculated_at")
    return payments.join(profiles, "customer_id", "left").join(devices, "device_id", "left")


_MISSING = {
    "behavioral_risk_score": 0,
    "linked_customer_count": 0,
    "network_transaction_count": 0,
    "network_total_amount": 0.0,
    "is_shared_device": False,
    "risk_segment": "UNKNOWN",
}
_REMOTE = one_of("payment_channel", REMOTE_CHANNELS)
_RULE_SCORES = {
    "amount_rule_score": band_from("amount", AMOUNT_BANDS, 1, otherwise=0),
    "channel_rule_score": f"CASE WHEN {_REMOTE} THEN {REMOTE_CHANNEL_POINTS} ELSE 0 END",
    "shared_device_rule_score": f"CASE WHEN is_shared_device THEN {SHARED_DEVICE_POINTS} ELSE 0 END",
    "customer_segment_score": f"CASE WHEN risk_segment = 'HIGH' THEN {HIGH_SEGMENT_POINTS} ELSE 0 END",
}


def rule_scores(enriched: DataFrame) -> DataFrame:
    """Defaults for missing features, the four rule scores, and the capped total."""
    total = " + ".join(["behavioral_risk_score", *_RULE_SCORES])
    scored = with_expr(enriched.fillna(_MISSING), **_RULE_SCORES)
    return with_expr(scored, risk_score=f"cast(least({MAX_SCORE}, {total}) AS int)")


def reasons(scored: DataFrame) -> DataFrame:
    """Transaction reason codes, behaviour codes, and both without repeats."""
    highest, lower = AMOUNT_BANDS
    own = codes(
        [
            (f"amount >= {highest[0]}", highest[2]),
            (f"amount >= {lower[0]} AND amount < {highest[0]}", lower[2]),
            (_REMOTE, "REMOTE_PAYMENT_CHANNEL"),
            ("is_shared_device", "SHARED_DEVICE_NETWORK"),
            ("risk_segment = 'HIGH'", "HIGH_RISK_CUSTOMER_SEGMENT"),
        ]
    )
    parts = with_expr(
        scored,
        transaction_reason_codes=own,
        behavior_reason_codes=f"coalesce(reason_codes, {NO_CODES})",
    )
    return with_expr(
        parts, reason_codes="array_distinct(concat(transaction_reason_codes, behavior_reason_codes))"
    )


def risk_bands(scored: DataFrame) -> DataFrame:
    *bands, lowest = DECISION_BANDS
    return with_expr(
        scored,
        risk_level=band_from("risk_score", bands, 1, otherwise=lowest[1]),
        recommended_action=band_from("risk_score", bands, 2, otherwise=lowest[2]),
    )


def decide(enriched: DataFrame, settings: Settings, keep: Sequence[str] = ()) -> DataFrame:
    """One explained decision per payment. Labels are never read; the columns named by
    ``keep`` are carried along."""
    version = quoted(settings.policy_version)
    decided = with_expr(
        risk_bands(reasons(rule_scores(enriched))),
        decision_id=hashed_id("transaction_id", version),
        policy_version=version,
        decisioned_at="current_timestamp()",
    )
    return require(decided.select(*DECISION_COLUMNS, *keep), DECISION_GUARD)


def open_actions(decisions: DataFrame) -> DataFrame:
    return decisions.filter(one_of("recommended_action", ("REVIEW", "BLOCK")))


def investigation_queue(decisions: DataFrame) -> DataFrame:
    """One open case per decision that a person must look at."""
    return with_expr(
        open_actions(decisions),
        case_id=hashed_id("'CASE'", "decision_id"),
        case_priority="CASE WHEN recommended_action = 'BLOCK' THEN 'P1' ELSE 'P2' END",
        case_status="'OPEN'",
        queue_name="'FINANCIAL_CRIME_OPERATIONS'",
        created_at="current_timestamp()",
    ).select(*CASE_COLUMNS)


def decision_metrics(decisions: DataFrame) -> DataFrame:
    """Daily volume, average score, amount and customers per outcome."""
    day = F.expr("to_date(event_timestamp) AS decision_date")
    per_day = decisions.groupBy(day, "risk_level", "recommended_action", "policy_version").agg(
        F.expr("count(*) AS decision_count"),
        F.expr("round(avg(risk_score), 2) AS average_risk_score"),
        F.expr("round(sum(amount), 2) AS payment_amount"),
        F.expr("count(DISTINCT customer_id) AS customer_count"),
    )
    return per_day.withColumn("metrics_calculated_at", F.current_timestamp())


# The daily metrics, kept up to date batch by batch (see sources/rollups.py).
METRICS_ROLLUP = Rollup(
    keys=("decision_date", "risk_level", "recommended_action", "policy_version"),
    sums={"decision_count": "1", "scored_count": "if(risk_score IS NULL, 0, 1)", "score_sum": "risk_score", "payment_amount": "amount"},
    distinct={"customer_count": "customer_id"},
)
# What it needs of a decision.
METRICS_INPUTS = ("event_timestamp", "customer_id", "amount", "risk_score", *METRICS_ROLLUP.keys[1:])


def metrics_rows(decisions: DataFrame) -> DataFrame:
    """Rows that a batch of decisions adds to ``METRICS_ROLLUP``."""
    return with_expr(decisions, decision_date="to_date(event_timestamp)")


def metrics_of_rollup(merged: DataFrame) -> DataFrame:
    """``decision_metrics`` from the merged rollup of all batches."""
    return merged.selectExpr(
        *METRICS_ROLLUP.keys, "decision_count", "round(double(score_sum) / scored_count, 2) AS average_risk_score",
        "round(payment_amount, 2) AS payment_amount", "customer_count", "current_timestamp() AS metrics_calculated_at",
    )
