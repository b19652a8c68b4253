"""Run configuration and the policy's fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """What one run may choose. Everything else in this module is policy."""

    policy_version: str = "2026.09.1"
    watermark: str = "1 day"
    stream_splits: int = 16
    token_namespace: str = ""


# --- Fixed values: the published policy ------------------------------------------
# Behaviour signals: count column, points per event, smallest count that is
# reported, reason code.
BEHAVIOR_SIGNALS = (
    ("failed_login_count", 4, 3, "REPEATED_LOGIN_FAILURES"),
    ("mfa_bypass_count", 30, 1, "MFA_BYPASS"),
    ("headless_client_count", 10, 1, "HEADLESS_CLIENT"),
    ("anonymized_network_count", 15, 1, "VPN_OR_TOR"),
    ("untrusted_device_count", 10, 1, "UNTRUSTED_DEVICE"),
    ("impossible_travel_count", 35, 1, "IMPOSSIBLE_TRAVEL"),
)

# Access signals: same four columns.
ACCESS_SIGNALS = (
    ("bulk_access_count", 25, 1, "BULK_DATA_ACCESS"),
    ("privileged_after_hours_count", 40, 1, "PRIVILEGED_AFTER_HOURS"),
)

MAX_SCORE = 100
HOME_COUNTRY = "CA"
BULK_ROWS = 10000
SHARED_DEVICE_CUSTOMERS = 3
ALERT_SCORE = 25

# Payment amount bands, highest first: lower bound, points, reason code.
AMOUNT_BANDS = (
    (1500, 25, "HIGH_VALUE_PAYMENT"),
    (750, 10, "ELEVATED_VALUE_PAYMENT"),
)
REMOTE_CHANNELS = ("ECOMMERCE", "MOBILE")
REMOTE_CHANNEL_POINTS = 5
SHARED_DEVICE_POINTS = 25
HIGH_SEGMENT_POINTS = 10

# Decision bands, highest first: lower score bound, risk level, action.
DECISION_BANDS = (
    (80, "CRITICAL", "BLOCK"),
    (60, "HIGH", "REVIEW"),
    (35, "MEDIUM", "STEP_UP_AUTH"),
    (0, "LOW", "ALLOW"),
)

# Access alert bands, highest first: lower score bound, risk level, action.
ALERT_BANDS = (
    (80, "CRITICAL", "SUSPEND_AND_REVIEW"),
    (50, "HIGH", "REVIEW"),
    (25, "MEDIUM", "REVIEW"),
)

# Model bands, lowest first: upper probability bound (inclusive), level, action.
MODEL_BANDS = (
    (0.35, "LOW", "ALLOW"),
    (0.60, "MEDIUM", "STEP_UP_AUTH"),
    (0.80, "HIGH", "REVIEW"),
    (1.00, "CRITICAL", "BLOCK"),
)

# Model explanation signals on counts: column, smallest count, signal.
EXPLANATION_SIGNALS = (
    ("amount", 1500, "HIGH_VALUE_PAYMENT"),
    ("failed_login_count", 1, "FAILED_LOGIN_ACTIVITY"),
    ("mfa_bypass_count", 1, "MFA_BYPASS"),
    ("headless_client_count", 1, "HEADLESS_CLIENT"),
    ("anonymized_network_count", 1, "ANONYMIZED_NETWORK"),
    ("untrusted_device_count", 1, "UNTRUSTED_DEVICE"),
    ("impossible_travel_count", 1, "IMPOSSIBLE_TRAVEL"),
    ("linked_customer_count", 3, "SHARED_DEVICE_NETWORK"),
)
NO_SIGNAL = "NO_ELEVATED_INPUT_SIGNAL"

# Model inputs.
NUMERIC_FEATURES = (
    "amount",
    "failed_login_count",
    "mfa_bypass_count",
    "headless_client_count",
    "anonymized_network_count",
    "untrusted_device_count",
    "impossible_travel_count",
    "linked_customer_count",
    "network_transaction_count",
)
CATEGORICAL_FEATURES = ("currency", "payment_channel", "risk_segment")

LEGITIMATE = "LEGITIMATE"
DISPOSITIONS = ("CONFIRMED_FRAUD", "FALSE_POSITIVE", "NEEDS_MORE_REVIEW")
# --- End of fixed values -----------------------------------------------------------


# What the jobs expect of a cluster session. ``session`` sets how many shuffle partitions a
# stage starts from; AQE merges small ones to the advisory size and splits those of a join
# or a rebalance that a hot key makes too large. Aggregates and windows are not split: the
# operators combine or cut hot keys themselves. A generated method of more than 8,000 bytes of code
# is never compiled by the JVM; such a stage is run operator by operator instead. Rows of a
# payment are mostly ids that resemble each other, which zstd writes in little more than half of lz4's bytes.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.io.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def session(
    app_name: str, input_bytes: int = 0, stream_partitions: int | None = None, **conf: str
) -> SparkSession:
    """A session with SESSION_CONF; ``conf`` uses double underscores for dots.

    ``input_bytes`` is what the largest join or aggregate of the job reads: batch stages start
    from that many bytes in parts of 128 MB, and AQE merges what turns out small. A stream's
    state keeps the number of partitions of its first run, so ``stream_partitions`` is a
    choice for the life of a checkpoint.
    """
    builder = SparkSession.builder.appName(app_name)
    initial = max(200, -(-input_bytes // (128 << 20)))
    builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial))
    if stream_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(stream_partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
