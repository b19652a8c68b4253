"""The five event feeds: columns, contract limits, and Bronze rule sets.

A feed is described once, as data. Typed projection, contract checks, rule sets,
streaming schemas and tests all read the same description.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One feed column and what its contract says about a value."""

    name: str
    type: str
    nullable: bool = False
    upper: bool = False
    length: tuple[int, int | None] | None = None
    allowed: tuple[str, ...] = ()
    minimum: float | None = None
    above: float | None = None
    maximum: float | None = None
    always: bool | None = None


@dataclass(frozen=True)
class Feed:
    """A feed: its fields, its record key, its event time, and its Bronze rules."""

    name: str
    key: str
    event_time: str
    fields: tuple[Field, ...]
    rules: dict[str, str]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        ddl = ", ".join(f"`{f.name}` {f.type}" for f in self.fields)
        return T.StructType.fromDDL(ddl)


_ANY = (1, None)


def _text(name, **limits):
    limits.setdefault("length", _ANY)
    return Field(name, "string", **limits)


def _one_of(name, values, **limits):
    return Field(name, "string", allowed=values, **limits)


def _tail(*labels):
    """Columns that close every event feed."""
    tail = (
        Field("source_sequence", "bigint", minimum=1),
        Field("is_synthetic", "boolean", always=True),
    )
    return tail + ((_one_of("scenario_label", labels),) if labels else ())


# --- Fixed values: contracts and rule sets ---------------------------------------
PAYMENT = Feed(
    name="payment",
    key="event_id",
    event_time="event_timestamp",
    fields=(
        _text("event_id"),
        Field("event_timestamp", "timestamp"),
        _text("transaction_id"),
        _text("customer_id"),
        _text("account_id"),
        _text("merchant_id"),
        _text("device_id"),
        _text("ip_address"),
        Field("amount", "decimal(18,2)", above=0),
        _one_of("currency", ("CAD", "USD", "EUR", "GBP")),
        _one_of("payment_channel", ("CARD_PRESENT", "ECOMMERCE", "MOBILE", "TRANSFER")),
        _one_of("event_type", ("AUTHORISATION", "CAPTURE", "REVERSAL", "TRANSFER")),
        *_tail("LEGITIMATE", "PAYMENT_FRAUD", "ACCOUNT_TAKEOVER", "MULE_NETWORK", "LAYERING"),
    ),
    rules={
        "payment_event_id_required": "event_id IS NOT NULL",
        "payment_timestamp_required": "event_timestamp IS NOT NULL",
        "payment_customer_required": "customer_id IS NOT NULL",
        "payment_amount_positive": "amount > 0",
        "payment_currency_supported": "currency IN ('CAD', 'USD', 'EUR', 'GBP')",
        "payment_sequence_positive": "source_sequence > 0",
    },
)

CUSTOMER_CHANGE = Feed(
    name="customer_change",
    key="change_id",
    event_time="change_timestamp",
    fields=(
        _text("change_id"),
        Field("change_timestamp", "timestamp"),
        _one_of("operation", ("INSERT", "UPDATE", "DELETE"), upper=True),
        _text("customer_id"),
        _one_of("risk_segment", ("LOW", "MEDIUM", "HIGH"), nullable=True),
        _text("country", nullable=True, length=(2, 2)),
        _text("email_hash", nullable=True, length=None),
        _text("phone_hash", nullable=True, length=None),
        *_tail(),
    ),
    rules={
        "customer_change_id_required": "change_id IS NOT NULL",
        "customer_id_required": "customer_id IS NOT NULL",
        "customer_change_timestamp_required": "change_timestamp IS NOT NULL",
        "customer_operation_supported": "operation IN ('INSERT', 'UPDATE', 'DELETE')",
        "customer_sequence_positive": "source_sequence > 0",
    },
)

AUTHENTICATION = Feed(
    name="authentication",
    key="auth_event_id",
    event_time="event_timestamp",
    fields=(
        _text("auth_event_id"),
        Field("event_timestamp", "timestamp"),
        _text("customer_id"),
        _text("account_id"),
        _text("session_id"),
        _text("device_id"),
        _text("ip_address"),
        _text("country", upper=True, length=(2, 2)),
        _text("city"),
        _one_of("auth_result", ("SUCCESS", "FAILURE"), upper=True),
        _text("failure_reason", nullable=True, length=None),
        _one_of("mfa_result", ("PASSED", "FAILED", "BYPASSED", "NOT_CHALLENGED"), upper=True),
        _text("user_agent"),
        *_tail("LEGITIMATE", "BRUTE_FORCE", "ACCOUNT_TAKEOVER"),
    ),
    rules={
        "auth_event_id_required": "auth_event_id IS NOT NULL",
        "auth_timestamp_required": "event_timestamp IS NOT NULL",
        "auth_customer_required": "customer_id IS NOT NULL",
        "auth_result_supported": "auth_result IN ('SUCCESS', 'FAILURE')",
        "auth_sequence_positive": "source_sequence > 0",
    },
)

DEVICE = Feed(
    name="device_intelligence",
    key="device_event_id",
    event_time="observed_at",
    fields=(
        _text("device_event_id"),
        Field("observed_at", "timestamp"),
        _text("customer_id"),
        _text("device_id"),
        _text("ip_address"),
        _text("country", upper=True, length=(2, 2)),
        _text("city"),
        Field("latitude", "double", minimum=-90, maximum=90),
        Field("longitude", "double", minimum=-180, maximum=180),
        _one_of("network_type", ("RESIDENTIAL", "CORPORATE", "MOBILE", "VPN", "TOR"), upper=True),
        Field("is_vpn", "boolean"),
        Field("is_tor", "boolean"),
        _one_of("device_trust", ("TRUSTED", "UNKNOWN", "BLOCKED"), upper=True),
        *_tail("LEGITIMATE", "IMPOSSIBLE_TRAVEL", "ANONYMIZED_NETWORK"),
    ),
    rules={
        "device_event_id_required": "device_event_id IS NOT NULL",
        "device_timestamp_required": "observed_at IS NOT NULL",
        "device_customer_required": "customer_id IS NOT NULL",
        "device_network_supported": (
            "network_type IN ('RESIDENTIAL', 'CORPORATE', 'MOBILE', 'VPN', 'TOR')"
        ),
        "device_sequence_positive": "source_sequence > 0",
    },
)

ACCESS = Feed(
    name="access",
    key="access_event_id",
    event_time="event_timestamp",
    fields=(
        _text("access_event_id"),
        Field("event_timestamp", "timestamp"),
        _text("actor_id"),
        _one_of("actor_type", ("CUSTOMER", "EMPLOYEE", "SERVICE_PRINCIPAL"), upper=True),
        _text("role_name"),
        _text("source_ip"),
        _text("resource_type"),
        _text("resource_name"),
        _text("action"),
        _one_of("access_result", ("ALLOWED", "DENIED"), upper=True),
        Field("rows_accessed", "bigint", minimum=0),
        Field("privileged_access", "boolean"),
        Field("outside_business_hours", "boolean"),
        *_tail("LEGITIMATE", "PRIVILEGED_ABUSE", "DATABASE_ANOMALY"),
    ),
    rules={
        "access_event_id_required": "access_event_id IS NOT NULL",
        "access_timestamp_required": "event_timestamp IS NOT NULL",
        "access_actor_required": "actor_id IS NOT NULL",
        "access_result_supported": "access_result IN ('ALLOWED', 'DENIED')",
        "access_rows_nonnegative": "rows_accessed >= 0",
        "access_sequence_positive": "source_sequence > 0",
    },
)

# Conditions that stop a Silver or Gold write when one row breaks them.
PAYMENT_GUARD = {
    "event_identity_complete": "event_id IS NOT NULL AND transaction_id IS NOT NULL",
    "payment_parties_complete": "customer_id IS NOT NULL AND account_id IS NOT NULL",
    "payment_timestamp_complete": "event_timestamp IS NOT NULL",
    "payment_amount_valid": "amount > 0",
}
CUSTOMER_GUARD = {"resolved_customer_required": "resolved_identity_id IS NOT NULL"}
AUTHENTICATION_GUARD = {
    "authentication_identity_complete": "auth_event_id IS NOT NULL AND customer_id IS NOT NULL",
}
DEVICE_GUARD = {
    "device_identity_complete": "device_event_id IS NOT NULL AND customer_id IS NOT NULL",
}
ACCESS_GUARD = {
    "access_identity_complete": "access_event_id IS NOT NULL AND actor_id IS NOT NULL",
}
DECISION_GUARD = {
    "decision_identity_complete": "decision_id IS NOT NULL AND transaction_id IS NOT NULL",
    "risk_score_bounded": "risk_score BETWEEN 0 AND 100",
    "action_supported": "recommended_action IN ('ALLOW', 'STEP_UP_AUTH', 'REVIEW', 'BLOCK')",
}
# --- End of fixed values -----------------------------------------------------------

FEEDS = {f.name: f for f in (PAYMENT, CUSTOMER_CHANGE, AUTHENTICATION, DEVICE, ACCESS)}
