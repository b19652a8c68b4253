"""Small feeds of the published size with the published patterns (FIXTURES.md, part A)."""

from __future__ import annotations

START = 1767225600  # 2026-01-01T00:00:00Z


def _id(prefix, number, width=8):
    return f"format_string('{prefix}_%0{width}d', {number})"


def _slot(cases, otherwise):
    return "CASE " + " ".join(f"WHEN i % 20 = {k} THEN {v}" for k, v in cases.items()) + f" ELSE {otherwise} END"


def payments(spark, rows=1000):
    customer = "CASE WHEN id % 20 IN (2, 3) THEN id % 6 ELSE id % 40 END"
    base = spark.range(rows).selectExpr("id AS i", f"{customer} AS c")
    device = _slot({0: 900, 1: 901, 2: 950}, "c")
    channel = _slot(
        {0: "'ECOMMERCE'", 1: "'MOBILE'", 2: "'TRANSFER'", 3: "'TRANSFER'"},
        "element_at(array('CARD_PRESENT', 'ECOMMERCE', 'MOBILE', 'TRANSFER'), int(i % 4 + 1))",
    )
    amount = _slot({0: "1500 + i % 700", 1: "900 + i % 600", 2: "500 + i % 350", 3: "250 + i % 400"}, "10 + i * 37 % 470")
    label = _slot(
        {0: "'PAYMENT_FRAUD'", 1: "'ACCOUNT_TAKEOVER'", 2: "'MULE_NETWORK'", 3: "'LAYERING'"},
        "'LEGITIMATE'",
    )
    return base.selectExpr(
        f"{_id('evt', 'i + 1', 16)} AS event_id",
        f"timestamp_seconds({START} + i * 15) AS event_timestamp",
        f"{_id('txn', 'i + 1', 16)} AS transaction_id",
        f"{_id('cus', 'c')} AS customer_id",
        f"{_id('acc', 'c')} AS account_id",
        f"{_id('mer', 'i % 12')} AS merchant_id",
        f"{_id('dev', device)} AS device_id",
        f"concat('10.0.0.', ({device}) % 250 + 1) AS ip_address",
        f"double({amount}) AS amount",
        "element_at(array('CAD', 'USD', 'EUR', 'GBP'), int(i % 4 + 1)) AS currency",
        f"{channel} AS payment_channel",
        f"CASE WHEN {channel} = 'TRANSFER' THEN 'TRANSFER' ELSE 'AUTHORISATION' END AS event_type",
        "i + 1 AS source_sequence",
        "true AS is_synthetic",
        f"{label} AS scenario_label",
    )


def customer_changes(spark, rows=200):
    half = rows // 2
    return spark.range(rows).selectExpr("id AS i", f"id % {half} AS c").selectExpr(
        f"{_id('chg', 'i + 1', 16)} AS change_id",
        f"timestamp_seconds({START} + i * 60) AS change_timestamp",
        f"CASE WHEN i < {half} THEN 'INSERT' ELSE 'UPDATE' END AS operation",
        f"{_id('cus', 'c')} AS customer_id",
        "CASE WHEN i % 11 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_segment",
        "element_at(array('CA', 'US', 'GB', 'DE'), int(i % 4 + 1)) AS country",
        "sha2(concat('email-', c), 256) AS email_hash",
        "sha2(concat('phone-', c), 256) AS phone_hash",
        "i + 1 AS source_sequence",
        "true AS is_synthetic",
    )


def authentication(spark, rows=500):
    forced, taken = "i % 25 < 5", "i % 25 = 5"
    device = f"CASE WHEN {forced} THEN 980 WHEN {taken} THEN 981 ELSE i % 40 END"
    return spark.range(rows).selectExpr("id AS i").selectExpr(
        f"{_id('auth', 'i + 1', 16)} AS auth_event_id",
        f"timestamp_seconds({START} + i * 20) AS event_timestamp",
        f"{_id('cus', 'i % 40')} AS customer_id",
        f"{_id('acc', 'i % 40')} AS account_id",
        f"{_id('ses', 'i + 1', 16)} AS session_id",
        f"{_id('dev', device)} AS device_id",
        f"concat('10.1.0.', ({device}) % 250 + 1) AS ip_address",
        f"CASE WHEN {taken} THEN 'NL' ELSE 'CA' END AS country",
        f"CASE WHEN {taken} THEN 'Amsterdam' ELSE 'Toronto' END AS city",
        f"CASE WHEN {forced} THEN 'FAILURE' ELSE 'SUCCESS' END AS auth_result",
        f"CASE WHEN {forced} THEN 'INVALID_PASSWORD' END AS failure_reason",
        f"CASE WHEN {taken} THEN 'BYPASSED' WHEN {forced} THEN 'NOT_CHALLENGED' ELSE 'PASSED' END AS mfa_result",
        f"CASE WHEN {forced} OR {taken} THEN 'HeadlessClient/1.0' ELSE 'Browser/1.0' END AS user_agent",
        "i + 1 AS source_sequence",
        "true AS is_synthetic",
        f"CASE WHEN {forced} THEN 'BRUTE_FORCE' WHEN {taken} THEN 'ACCOUNT_TAKEOVER' ELSE 'LEGITIMATE' END AS scenario_label",
    )


def devices(spark, rows=500):
    far, hidden = "i % 30 = 0", "i % 30 = 1"
    device = f"CASE WHEN {far} THEN 990 WHEN {hidden} THEN 991 ELSE i % 40 END"
    return spark.range(rows).selectExpr("id AS i").selectExpr(
        f"{_id('dvi', 'i + 1', 16)} AS device_event_id",
        f"timestamp_seconds({START} + i * 30) AS observed_at",
        f"{_id('cus', 'i % 40')} AS customer_id",
        f"{_id('dev', device)} AS device_id",
        f"concat('10.2.0.', ({device}) % 250 + 1) AS ip_address",
        f"CASE WHEN {far} THEN 'SG' ELSE 'CA' END AS country",
        f"CASE WHEN {far} THEN 'Singapore' ELSE 'Toronto' END AS city",
        f"CASE WHEN {far} THEN 1.3521D ELSE 43.6532D END AS latitude",
        f"CASE WHEN {far} THEN 103.8198D ELSE -79.3832D END AS longitude",
        f"CASE WHEN {far} THEN 'VPN' WHEN {hidden} THEN 'TOR' ELSE 'RESIDENTIAL' END AS network_type",
        f"{far} AS is_vpn",
        f"{hidden} AS is_tor",
        f"CASE WHEN {hidden} THEN 'BLOCKED' WHEN {far} THEN 'UNKNOWN' ELSE 'TRUSTED' END AS device_trust",
        "i + 1 AS source_sequence",
        "true AS is_synthetic",
        f"CASE WHEN {far} THEN 'IMPOSSIBLE_TRAVEL' WHEN {hidden} THEN 'ANONYMIZED_NETWORK' ELSE 'LEGITIMATE' END AS scenario_label",
    )


def access(spark, rows=200):
    export, bulk = "i % 40 = 0", "i % 40 = 1"
    kind = f"CASE WHEN {export} THEN 'CUSTOMER_TABLE' WHEN {bulk} THEN 'PAYMENT_TABLE' ELSE 'CASE' END"
    return spark.range(rows).selectExpr("id AS i").selectExpr(
        f"{_id('acs', 'i + 1', 16)} AS access_event_id",
        f"timestamp_seconds({START} + i * 45) AS event_timestamp",
        f"{_id('usr', 'i % 20')} AS actor_id",
        "'EMPLOYEE' AS actor_type",
        f"CASE WHEN {export} THEN 'PLATFORM_ADMIN' ELSE 'ANALYST' END AS role_name",
        "concat('10.3.0.', i % 20 + 1) AS source_ip",
        f"{kind} AS resource_type",
        f"concat('table_', lower({kind})) AS resource_name",
        f"CASE WHEN {export} THEN 'EXPORT' WHEN {bulk} THEN 'BULK_READ' ELSE 'READ' END AS action",
        "'ALLOWED' AS access_result",
        f"CASE WHEN {export} THEN 50000L WHEN {bulk} THEN 25000L ELSE i % 25 + 1 END AS rows_accessed",
        f"{export} AS privileged_access",
        f"{export} OR {bulk} AS outside_business_hours",
        "i + 1 AS source_sequence",
        "true AS is_synthetic",
        f"CASE WHEN {export} THEN 'PRIVILEGED_ABUSE' WHEN {bulk} THEN 'DATABASE_ANOMALY' ELSE 'LEGITIMATE' END AS scenario_label",
    )


def all_feeds(spark):
    return {
        "payment": payments(spark),
        "customer_change": customer_changes(spark),
        "authentication": authentication(spark),
        "device_intelligence": devices(spark),
        "access": access(spark),
    }
