"""Pseudonymised investigator output and the control inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.columns import token

# --- Fixed values: token column, prefix, protected id; then the open columns
TOKENS = (
    ("transaction_token", "txn_", "transaction_id"),
    ("customer_token", "cus_", "customer_id"),
    ("account_token", "acc_", "account_id"),
    ("merchant_token", "mer_", "merchant_id"),
    ("device_token", "dev_", "device_id"),
)
OPEN_COLUMNS = (
    "event_timestamp", "amount", "currency", "payment_channel", "fraud_probability",
    "ml_prediction", "ml_risk_level", "ml_recommended_action", "explanation_signals",
    "policy_risk_score", "policy_risk_level", "policy_recommended_action", "policy_reason_codes",
    "model_policy_action_agreement", "model_policy_risk_gap", "registered_model_name",
    "registered_model_version", "model_alias", "policy_version", "scored_at",
)
# Controls: id, name, what is claimed. The text states the intent of a control; that a
# schema has no other grants or that a model was approved is not checked here.
CONTROLS = (
    ("GOV-001", "Least privilege", "No grants beyond the owner"),
    ("GOV-002", "Pseudonymized investigator access", "Direct party, transaction and event identifiers excluded"),
    ("GOV-003", "Synthetic-data classification", "All demonstration data is synthetic"),
    ("GOV-004", "Model governance", "Scoring loads the approved model version"),
    ("GOV-005", "Analyst feedback auditability", "Append-only log with checked dispositions"),
)
# --- End of fixed values -----------------------------------------------------------


def protected(
    scored: DataFrame, namespace: str, tokens: Sequence[Sequence[str]] = TOKENS, columns: Sequence[str] = OPEN_COLUMNS
) -> DataFrame:
    """Tokens instead of ids beside the open columns. ``namespace`` is a secret."""
    if not namespace:
        raise ValueError("a token namespace is required")
    hidden = [f"{token(prefix, namespace, source)} AS {name}" for name, prefix, source in tokens]
    return scored.selectExpr(*hidden, *columns)


def protected_view(scored: DataFrame, namespace: str, name: str) -> DataFrame:
    """Define the session view ``name`` over the protected projection."""
    protected(scored, namespace).createOrReplaceTempView(name)
    return scored.sparkSession.table(name)


def control_inventory(
    spark: SparkSession, schema: str, view: str, model: str, feedback: str
) -> DataFrame:
    """The five controls and the objects they govern."""
    governed = (schema, view, schema, model, feedback)
    rows = [(number, name, what, claim) for (number, name, claim), what in zip(CONTROLS, governed)]
    return spark.createDataFrame(
        [(*r, "ENABLED") for r in rows],
        "control_id string, control_name string, governed_object string, evidence string, "
        "control_status string",
    ).withColumn("validated_at", F.current_timestamp())
