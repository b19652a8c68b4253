"""The same queries as plain SQL for DuckDB, over the same tables.

Written from the rules in FIXTURES.md and the policy tables, not from the Spark code,
so that the two can disagree.
"""

from __future__ import annotations

import re

NAMESPACE = "example-namespace"
VERSION = "2026.09.1"


def _t(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name or c}"


def _m(c: str, name: str | None = None) -> str:
    return f"CAST({c} AS DOUBLE) AS {name or c}"


def _b(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def _fails(**rules: str) -> str:
    """Comma text of the rules that do not hold, in order."""
    cases = [f"CASE WHEN coalesce({p}, false) THEN NULL ELSE '{n}' END" for n, p in rules.items()]
    return f"concat_ws(',', {', '.join(cases)})"


def _notes(**codes: str) -> str:
    """Comma text of the codes whose condition holds, in order."""
    cases = [f"CASE WHEN {p} THEN '{n}' END" for n, p in codes.items()]
    return f"concat_ws(',', {', '.join(cases)})"


_RULES: dict[str, dict[str, str]] = {}


def _feed_fails(table: str, **rules: str) -> str:
    _RULES[table] = rules
    return _fails(**rules)


_PAY_FAILS = _feed_fails(
    "pay",
    payment_event_id_required="event_id IS NOT NULL",
    payment_timestamp_required="event_timestamp IS NOT NULL",
    payment_customer_required="customer_id IS NOT NULL",
    payment_amount_positive="amount > 0",
    payment_currency_supported="currency IN ('CAD', 'USD', 'EUR', 'GBP')",
    payment_sequence_positive="source_sequence > 0",
)
_CUST_FAILS = _feed_fails(
    "cust",
    customer_change_id_required="change_id IS NOT NULL",
    customer_id_required="customer_id IS NOT NULL",
    customer_change_timestamp_required="change_timestamp IS NOT NULL",
    customer_operation_supported="operation IN ('INSERT', 'UPDATE', 'DELETE')",
    customer_sequence_positive="source_sequence > 0",
)
_AUTH_FAILS = _feed_fails(
    "auth",
    auth_event_id_required="auth_event_id IS NOT NULL",
    auth_timestamp_required="event_timestamp IS NOT NULL",
    auth_customer_required="customer_id IS NOT NULL",
    auth_result_supported="auth_result IN ('SUCCESS', 'FAILURE')",
    auth_sequence_positive="source_sequence > 0",
)
_DEV_FAILS = _feed_fails(
    "dev",
    device_event_id_required="device_event_id IS NOT NULL",
    device_timestamp_required="observed_at IS NOT NULL",
    device_customer_required="customer_id IS NOT NULL",
    device_network_supported="network_type IN ('RESIDENTIAL', 'CORPORATE', 'MOBILE', 'VPN', 'TOR')",
    device_sequence_positive="source_sequence > 0",
    is_vpn_malformed="is_vpn IS NOT NULL",
)
_ACC_FAILS = _feed_fails(
    "acc",
    access_event_id_required="access_event_id IS NOT NULL",
    access_timestamp_required="event_timestamp IS NOT NULL",
    access_actor_required="actor_id IS NOT NULL",
    access_result_supported="access_result IN ('ALLOWED', 'DENIED')",
    access_rows_nonnegative="rows_accessed >= 0",
    access_sequence_positive="source_sequence > 0",
)


def _event(prefix: str, key: str, time: str, party: str, value: str) -> str:
    """Id, time, party and sequence of an event feed, of which a few rows lack one."""
    return f"""CASE WHEN event_id % 997 <> 1 THEN '{prefix}' || event_id END AS {key},
               CASE WHEN event_id % 997 <> 2 THEN ts END AS {time},
               CASE WHEN event_id % 997 <> 3 THEN {value} END AS {party},
               CASE WHEN event_id % 997 = 4 THEN -1 ELSE event_id + 1 + copy * 1000000 END AS source_sequence,
               true AS is_synthetic"""


def _cased(value: str) -> str:
    return f"CASE WHEN k % 10 = 3 THEN lower({value}) ELSE {value} END"


# Sub-queries by name; each may use those before it.
CTES: dict[str, str] = {
    "ev": """SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "pay": """
        SELECT CASE WHEN l_orderkey % 997 <> 1 THEN 'evt_' || l_orderkey || '_' || l_linenumber END AS event_id,
               CASE WHEN l_orderkey % 997 <> 2 THEN l_shipdate END AS event_timestamp,
               'txn_' || l_orderkey || '_' || l_linenumber AS transaction_id,
               CASE WHEN l_orderkey % 997 <> 3 THEN 'cus_' || o_custkey END AS customer_id,
               'acc_' || o_custkey AS account_id,
               'mer_' || l_suppkey AS merchant_id,
               'dev_' || l_partkey || '_' || l_linenumber AS device_id,
               '10.0.0.' || (l_suppkey % 250 + 1) AS ip_address,
               CAST(CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN NULL
                         WHEN l_suppkey % 40 = 1 AND l_linenumber = 6 THEN -1
                         ELSE l_quantity * 40 + l_linenumber END AS DECIMAL(18,2)) AS amount,
               CASE WHEN l_suppkey % 50 = 0 THEN 'XXX'
                    ELSE ['CAD', 'USD', 'EUR', 'GBP'][l_suppkey % 4 + 1] END AS currency,
               ['CARD_PRESENT', 'ECOMMERCE', 'MOBILE', 'TRANSFER'][l_linenumber % 4 + 1] AS payment_channel,
               CASE WHEN l_linenumber % 4 = 3 THEN 'TRANSFER' ELSE 'AUTHORISATION' END AS event_type,
               CASE WHEN l_orderkey % 997 = 4 THEN -1 ELSE l_partkey * 100000 + l_suppkey + 1 END AS source_sequence,
               true AS is_synthetic,
               CASE WHEN l_returnflag = 'R' THEN 'PAYMENT_FRAUD' ELSE 'LEGITIMATE' END AS scenario_label
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pay_ok": f"SELECT * FROM pay WHERE {_PAY_FAILS} = ''",
    "again": "SELECT *, unnest(CASE WHEN event_id % 25 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM ev",
    "pay_once": """
        SELECT * FROM pay_ok QUALIFY row_number() OVER (
            PARTITION BY event_id
            ORDER BY source_sequence, event_timestamp, amount, transaction_id, customer_id,
                     account_id, merchant_id, device_id, ip_address, currency, payment_channel,
                     event_type, scenario_label) = 1""",
    "cust_raw": f"""
        SELECT {_event('chg_', 'change_id', 'change_timestamp', 'customer_id', "'cus_' || user_id")},
               {_cased("CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type = 'error' AND k < 50 THEN 'DELETE' "
                       "WHEN event_type = 'view' AND k = 51 THEN 'MERGE' ELSE 'UPDATE' END")} AS operation,
               CASE WHEN k = 13 THEN NULL WHEN k % 22 = 0 THEN ' high '
                    WHEN k % 11 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_segment,
               ['CA', 'us ', 'GB', 'DE'][k % 4 + 1] AS country,
               CASE WHEN k % 7 <> 0 THEN sha256(CAST(user_id AS VARCHAR)) END AS email_hash,
               CASE WHEN k % 5 <> 0 THEN sha256(CAST(user_id AS VARCHAR)) END AS phone_hash
        FROM (SELECT *, 0 AS copy FROM ev)""",
    "cust": "SELECT * REPLACE (upper(operation) AS operation) FROM cust_raw",
    "cust_ok": f"SELECT * FROM cust WHERE {_CUST_FAILS} = ''",
    "cust_now": """
        SELECT * EXCLUDE (operation, change_id) FROM (
            SELECT * FROM cust_ok QUALIFY row_number() OVER (
                PARTITION BY customer_id
                ORDER BY source_sequence DESC, change_timestamp DESC, change_id DESC) = 1)
        WHERE operation <> 'DELETE'""",
    "cust_id": """
        SELECT * REPLACE (upper(trim(country)) AS country, upper(trim(risk_segment)) AS risk_segment),
               sha256(coalesce(email_hash, 'missing-email') || '|' || coalesce(phone_hash, 'missing-phone'))
                   AS resolved_identity_id,
               CASE WHEN email_hash IS NOT NULL AND phone_hash IS NOT NULL
                    THEN 'EMAIL_AND_PHONE_HASH' ELSE 'PARTIAL_HASH_IDENTITY' END AS identity_match_method
        FROM cust_now""",
    "auth_raw": f"""
        SELECT {_event('auth_', 'auth_event_id', 'event_timestamp', 'customer_id', "'cus_' || user_id")},
               'acc_' || user_id AS account_id,
               'ses_' || event_id AS session_id, 'dev_' || k AS device_id,
               '10.1.0.' || (event_id % 50) AS ip_address, 'ca' AS country, 'Toronto' AS city,
               {_cased("CASE WHEN event_type = 'error' AND k < 8 THEN 'FAILURE' "
                       "WHEN event_type = 'purchase' AND k = 50 THEN 'TIMEOUT' ELSE 'SUCCESS' END")} AS auth_result,
               CASE WHEN event_type = 'error' AND k < 8 THEN 'INVALID_PASSWORD' END AS failure_reason,
               {_cased("CASE WHEN event_type = 'signup' AND k < 1 THEN 'BYPASSED' "
                       "WHEN event_type = 'error' AND k < 8 THEN 'NOT_CHALLENGED' ELSE 'PASSED' END")} AS mfa_result,
               CASE WHEN event_type = 'view' AND k < 2 THEN 'HeadlessClient/1.0' ELSE 'Browser/1.0' END AS user_agent,
               CASE WHEN event_type = 'error' AND k < 8 THEN 'BRUTE_FORCE'
                    WHEN event_type = 'signup' AND k < 1 THEN 'ACCOUNT_TAKEOVER' ELSE 'LEGITIMATE' END AS scenario_label
        FROM again""",
    "auth": """SELECT * REPLACE (upper(country) AS country, upper(auth_result) AS auth_result,
                                upper(mfa_result) AS mfa_result) FROM auth_raw""",
    "auth_ok": f"SELECT * FROM auth WHERE {_AUTH_FAILS} = ''",
    "auth_once": """
        SELECT * FROM auth_ok QUALIFY row_number() OVER (
            PARTITION BY auth_event_id ORDER BY source_sequence, event_timestamp) = 1""",
    "auth_flag": """
        SELECT *, auth_result = 'FAILURE' AS is_failed_login, mfa_result = 'BYPASSED' AS is_mfa_bypass,
               lower(user_agent) LIKE '%headless%' AS is_headless_client
        FROM auth_once""",
    "dev_raw": f"""
        SELECT {_event('dvi_', 'device_event_id', 'observed_at', 'customer_id', "'cus_' || (user_id + 7)")},
               'dev_' || k AS device_id,
               '10.2.0.' || (event_id % 50) AS ip_address,
               CASE WHEN k = 96 THEN 'sg' ELSE 'ca' END AS country,
               CASE WHEN k = 96 THEN 'Singapore' ELSE 'Toronto' END AS city,
               CAST(CASE WHEN k = 96 THEN 1.3521 ELSE 43.6532 END AS DOUBLE) AS latitude,
               CAST(CASE WHEN k = 96 THEN 103.8198 ELSE -79.3832 END AS DOUBLE) AS longitude,
               {_cased("CASE WHEN k = 98 THEN 'VPN' WHEN k = 99 THEN 'TOR' WHEN k = 50 THEN 'SATELLITE' "
                       "ELSE 'RESIDENTIAL' END")} AS network_type,
               CASE WHEN k = 51 THEN NULL ELSE k = 98 END AS is_vpn,
               k = 99 AS is_tor,
               {_cased("CASE WHEN k >= 97 THEN 'UNKNOWN' ELSE 'TRUSTED' END")} AS device_trust,
               CASE WHEN k = 96 THEN 'IMPOSSIBLE_TRAVEL' WHEN k >= 98 THEN 'ANONYMIZED_NETWORK'
                    ELSE 'LEGITIMATE' END AS scenario_label
        FROM again""",
    "dev": """SELECT * REPLACE (upper(country) AS country, upper(network_type) AS network_type,
                               upper(device_trust) AS device_trust) FROM dev_raw""",
    "dev_ok": f"SELECT * FROM dev WHERE {_DEV_FAILS} = ''",
    "dev_once": """
        SELECT * FROM dev_ok QUALIFY row_number() OVER (
            PARTITION BY device_event_id ORDER BY source_sequence, observed_at) = 1""",
    "dev_flag": """
        SELECT *, is_vpn OR is_tor AS is_anonymized_network, device_trust <> 'TRUSTED' AS is_untrusted_device
        FROM dev_once""",
    "acc_raw": f"""
        SELECT {_event('acs_', 'access_event_id', 'event_timestamp', 'actor_id', "'usr_' || user_id")},
               {_cased("'EMPLOYEE'")} AS actor_type, event_type AS role_name,
               '10.3.0.' || (user_id % 250) AS source_ip, 'CASE' AS resource_type,
               'case_table' AS resource_name, 'READ' AS action,
               {_cased("CASE WHEN event_type = 'error' AND k = 60 THEN 'FAILED' ELSE 'ALLOWED' END")} AS access_result,
               CASE WHEN event_type = 'view' AND k = 50 THEN -1
                    ELSE CAST(round(value * 100) AS BIGINT) // 2 END AS rows_accessed,
               event_type = 'purchase' AS privileged_access, hour(ts) < 1 AS outside_business_hours,
               CASE WHEN event_type = 'purchase' AND hour(ts) < 1 THEN 'PRIVILEGED_ABUSE'
                    ELSE 'LEGITIMATE' END AS scenario_label
        FROM again""",
    "acc": "SELECT * REPLACE (upper(actor_type) AS actor_type, upper(access_result) AS access_result) FROM acc_raw",
    "acc_ok": f"SELECT * FROM acc WHERE {_ACC_FAILS} = ''",
    "acc_once": """
        SELECT * FROM acc_ok QUALIFY row_number() OVER (
            PARTITION BY access_event_id ORDER BY source_sequence, event_timestamp) = 1""",
    "acc_flag": """
        SELECT *, rows_accessed >= 10000 AS is_bulk_access,
               privileged_access AND outside_business_hours AS is_privileged_after_hours
        FROM acc_once""",
    "edge_row": """
        SELECT 'OWNS' AS edge_type, 'CUSTOMER' AS source_type, customer_id AS source_id,
               'ACCOUNT' AS target_type, account_id AS target_id, transaction_id, event_timestamp,
               amount, currency, scenario_label FROM pay_once
        UNION ALL
        SELECT 'PAYS', 'ACCOUNT', account_id, 'MERCHANT', merchant_id, transaction_id, event_timestamp,
               amount, currency, scenario_label FROM pay_once
        UNION ALL
        SELECT 'USES', 'CUSTOMER', customer_id, 'DEVICE', device_id, transaction_id, event_timestamp,
               amount, currency, scenario_label FROM pay_once""",
    "edge": """
        SELECT edge_type, source_type, source_id, target_type, target_id, currency,
               count(DISTINCT transaction_id) AS transaction_count,
               round(sum(amount), 2) AS total_amount,
               min(event_timestamp) AS first_seen_at, max(event_timestamp) AS last_seen_at,
               CAST(sum(CASE WHEN scenario_label <> 'LEGITIMATE' THEN 1 ELSE 0 END) AS BIGINT)
                   AS labeled_risk_event_count
        FROM edge_row GROUP BY ALL""",
    "net": """
        SELECT target_id AS device_id, count(DISTINCT source_id) AS linked_customer_count,
               CAST(sum(transaction_count) AS BIGINT) AS network_transaction_count,
               round(sum(total_amount), 2) AS network_total_amount,
               max(last_seen_at) AS network_last_seen_at,
               count(DISTINCT source_id) >= 3 AS is_shared_device
        FROM edge WHERE edge_type = 'USES' AND target_type = 'DEVICE' GROUP BY target_id""",
    "auth_f": """
        SELECT customer_id, count(*) AS authentication_count,
               CAST(sum(is_failed_login::INT) AS BIGINT) AS failed_login_count,
               CAST(sum(is_mfa_bypass::INT) AS BIGINT) AS mfa_bypass_count,
               CAST(sum(is_headless_client::INT) AS BIGINT) AS headless_client_count,
               count(DISTINCT device_id) AS authentication_device_count,
               count(DISTINCT ip_address) AS authentication_ip_count,
               max(event_timestamp) AS last_authentication_at
        FROM auth_flag GROUP BY customer_id""",
    "dev_f": """
        SELECT customer_id, count(DISTINCT device_id) AS observed_device_count,
               count(DISTINCT country) AS observed_country_count,
               CAST(sum(is_anonymized_network::INT) AS BIGINT) AS anonymized_network_count,
               CAST(sum(is_untrusted_device::INT) AS BIGINT) AS untrusted_device_count,
               CAST(sum((upper(country) <> 'CA')::INT) AS BIGINT) AS impossible_travel_count,
               max(observed_at) AS last_device_observation_at
        FROM dev_flag GROUP BY customer_id""",
    "beh_n": """
        SELECT customer_id, coalesce(authentication_count, 0) AS authentication_count,
               coalesce(failed_login_count, 0) AS failed_login_count,
               coalesce(mfa_bypass_count, 0) AS mfa_bypass_count,
               coalesce(headless_client_count, 0) AS headless_client_count,
               coalesce(authentication_device_count, 0) AS authentication_device_count,
               coalesce(authentication_ip_count, 0) AS authentication_ip_count,
               last_authentication_at,
               coalesce(observed_device_count, 0) AS observed_device_count,
               coalesce(observed_country_count, 0) AS observed_country_count,
               coalesce(anonymized_network_count, 0) AS anonymized_network_count,
               coalesce(untrusted_device_count, 0) AS untrusted_device_count,
               coalesce(impossible_travel_count, 0) AS impossible_travel_count,
               last_device_observation_at
        FROM auth_f FULL JOIN dev_f USING (customer_id)""",
    "beh": f"""
        SELECT *, least(100, 4 * failed_login_count + 30 * mfa_bypass_count + 10 * headless_client_count
                        + 15 * anonymized_network_count + 10 * untrusted_device_count
                        + 35 * impossible_travel_count) AS behavioral_risk_score,
               {_notes(
                   REPEATED_LOGIN_FAILURES="failed_login_count >= 3",
                   MFA_BYPASS="mfa_bypass_count > 0",
                   HEADLESS_CLIENT="headless_client_count > 0",
                   VPN_OR_TOR="anonymized_network_count > 0",
                   UNTRUSTED_DEVICE="untrusted_device_count > 0",
                   IMPOSSIBLE_TRAVEL="impossible_travel_count > 0",
               )} AS reason_codes
        FROM beh_n""",
    "sig_n": """
        SELECT actor_id, role_name, count(*) AS access_event_count,
               CAST(sum(is_bulk_access::INT) AS BIGINT) AS bulk_access_count,
               CAST(sum(is_privileged_after_hours::INT) AS BIGINT) AS privileged_after_hours_count,
               max(rows_accessed) AS maximum_rows_accessed, max(event_timestamp) AS last_access_at
        FROM acc_flag GROUP BY actor_id, role_name""",
    "sig": f"""
        SELECT *, least(100, 25 * bulk_access_count + 40 * privileged_after_hours_count) AS access_risk_score,
               {_notes(BULK_DATA_ACCESS="bulk_access_count > 0",
                       PRIVILEGED_AFTER_HOURS="privileged_after_hours_count > 0")} AS reason_codes
        FROM sig_n""",
    "enr": """
        SELECT p.*, c.risk_segment AS segment, c.resolved_identity_id,
               b.failed_login_count, b.mfa_bypass_count, b.headless_client_count,
               b.anonymized_network_count, b.untrusted_device_count, b.impossible_travel_count,
               b.behavioral_risk_score AS behavior_score, b.reason_codes AS behavior_codes,
               n.linked_customer_count AS linked, n.network_transaction_count AS net_count,
               n.network_total_amount AS net_amount, n.is_shared_device AS shared
        FROM pay_once p
        LEFT JOIN cust_id c ON p.customer_id = c.customer_id
        LEFT JOIN beh b ON p.customer_id = b.customer_id
        LEFT JOIN net n ON p.device_id = n.device_id""",
    "rule": """
        SELECT *, coalesce(behavior_score, 0) AS behavioral_risk_score,
               coalesce(linked, 0) AS linked_customer_count,
               coalesce(net_count, 0) AS network_transaction_count,
               coalesce(net_amount, 0) AS network_total_amount,
               coalesce(shared, false) AS is_shared_device,
               coalesce(segment, 'UNKNOWN') AS risk_segment,
               CASE WHEN amount >= 1500 THEN 25 WHEN amount >= 750 THEN 10 ELSE 0 END AS amount_rule_score,
               CASE WHEN payment_channel IN ('ECOMMERCE', 'MOBILE') THEN 5 ELSE 0 END AS channel_rule_score,
               CASE WHEN coalesce(shared, false) THEN 25 ELSE 0 END AS shared_device_rule_score,
               CASE WHEN segment = 'HIGH' THEN 10 ELSE 0 END AS customer_segment_score
        FROM enr""",
    "ruled": """
        SELECT *, CAST(least(100, behavioral_risk_score + amount_rule_score + channel_rule_score
                             + shared_device_rule_score + customer_segment_score) AS INTEGER) AS risk_score
        FROM rule""",
    "deci": f"""
        SELECT sha256(transaction_id || '|{VERSION}') AS decision_id, transaction_id, event_id,
               event_timestamp, customer_id, account_id, merchant_id, device_id, amount, currency,
               payment_channel, risk_score,
               CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH'
                    WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
               CASE WHEN risk_score >= 80 THEN 'BLOCK' WHEN risk_score >= 60 THEN 'REVIEW'
                    WHEN risk_score >= 35 THEN 'STEP_UP_AUTH' ELSE 'ALLOW' END AS recommended_action,
               concat_ws(',', nullif({_notes(
                   HIGH_VALUE_PAYMENT="amount >= 1500",
                   ELEVATED_VALUE_PAYMENT="amount >= 750 AND amount < 1500",
                   REMOTE_PAYMENT_CHANNEL="payment_channel IN ('ECOMMERCE', 'MOBILE')",
                   SHARED_DEVICE_NETWORK="is_shared_device",
                   HIGH_RISK_CUSTOMER_SEGMENT="risk_segment = 'HIGH'",
               )}, ''), nullif(behavior_codes, '')) AS reason_codes,
               behavioral_risk_score, linked_customer_count, resolved_identity_id,
               '{VERSION}' AS policy_version
        FROM ruled""",
    "feat": """
        SELECT event_id, transaction_id, event_timestamp, customer_id, account_id, merchant_id, device_id,
               amount, coalesce(failed_login_count, 0) AS failed_login_count,
               coalesce(mfa_bypass_count, 0) AS mfa_bypass_count,
               coalesce(headless_client_count, 0) AS headless_client_count,
               coalesce(anonymized_network_count, 0) AS anonymized_network_count,
               coalesce(untrusted_device_count, 0) AS untrusted_device_count,
               coalesce(impossible_travel_count, 0) AS impossible_travel_count,
               coalesce(linked, 0) AS linked_customer_count,
               coalesce(net_count, 0) AS network_transaction_count,
               coalesce(currency, 'UNKNOWN') AS currency,
               coalesce(payment_channel, 'UNKNOWN') AS payment_channel,
               coalesce(segment, 'UNKNOWN') AS risk_segment,
               CASE WHEN scenario_label <> 'LEGITIMATE' THEN 1 ELSE 0 END AS label,
               CAST(((source_sequence // 100000) * 37 + source_sequence) % 1001 AS DOUBLE) / 1000
                   AS fraud_probability
        FROM enr""",
    "expl": f"""
        SELECT *, {_notes(
                   HIGH_VALUE_PAYMENT="amount >= 1500",
                   FAILED_LOGIN_ACTIVITY="failed_login_count > 0",
                   MFA_BYPASS="mfa_bypass_count > 0",
                   HEADLESS_CLIENT="headless_client_count > 0",
                   ANONYMIZED_NETWORK="anonymized_network_count > 0",
                   UNTRUSTED_DEVICE="untrusted_device_count > 0",
                   IMPOSSIBLE_TRAVEL="impossible_travel_count > 0",
                   SHARED_DEVICE_NETWORK="linked_customer_count >= 3",
                   HIGH_RISK_CUSTOMER_SEGMENT="risk_segment = 'HIGH'",
               )} AS found,
               CASE WHEN fraud_probability >= 0.5 THEN 1 ELSE 0 END AS ml_prediction,
               CASE WHEN fraud_probability <= CAST(0.35 AS DOUBLE) THEN 'LOW'
                    WHEN fraud_probability <= CAST(0.60 AS DOUBLE) THEN 'MEDIUM'
                    WHEN fraud_probability <= CAST(0.80 AS DOUBLE) THEN 'HIGH'
                    WHEN fraud_probability <= 1 THEN 'CRITICAL' END AS ml_risk_level
        FROM feat""",
    "sco": """
        SELECT * EXCLUDE (found, label),
               CASE ml_risk_level WHEN 'LOW' THEN 'ALLOW' WHEN 'MEDIUM' THEN 'STEP_UP_AUTH'
                    WHEN 'HIGH' THEN 'REVIEW' WHEN 'CRITICAL' THEN 'BLOCK' END AS ml_recommended_action,
               CASE WHEN found = '' THEN 'NO_ELEVATED_INPUT_SIGNAL' ELSE found END AS explanation_signals,
               'fraud_model' AS registered_model_name, '1' AS registered_model_version,
               'current' AS model_alias, TIMESTAMP '2026-01-01 00:00:00' AS scored_at
        FROM expl""",
    "cmp": """
        SELECT s.*, d.risk_score AS policy_risk_score, d.risk_level AS policy_risk_level,
               d.recommended_action AS policy_recommended_action, d.reason_codes AS policy_reason_codes,
               d.policy_version,
               s.ml_recommended_action = d.recommended_action AS model_policy_action_agreement,
               round(s.fraud_probability * 100 - d.risk_score, 2) AS model_policy_risk_gap
        FROM sco s LEFT JOIN deci d ON s.event_id = d.event_id""",
    "prot": f"""
        SELECT 'txn_' || substr(sha256('{NAMESPACE}|' || transaction_id), 1, 16) AS transaction_token,
               'cus_' || substr(sha256('{NAMESPACE}|' || customer_id), 1, 16) AS customer_token,
               'acc_' || substr(sha256('{NAMESPACE}|' || account_id), 1, 16) AS account_token,
               'mer_' || substr(sha256('{NAMESPACE}|' || merchant_id), 1, 16) AS merchant_token,
               'dev_' || substr(sha256('{NAMESPACE}|' || device_id), 1, 16) AS device_token,
               event_timestamp, amount, currency, payment_channel, fraud_probability, ml_prediction,
               ml_risk_level, ml_recommended_action, explanation_signals, policy_risk_score,
               policy_risk_level, policy_recommended_action, policy_reason_codes,
               model_policy_action_agreement, model_policy_risk_gap, registered_model_name,
               registered_model_version, model_alias, policy_version, scored_at
        FROM cmp""",
    "met": """
        SELECT registered_model_name, registered_model_version, model_alias, ml_risk_level,
               ml_recommended_action, count(*) AS scored_transaction_count,
               round(avg(fraud_probability), 4) AS average_fraud_probability,
               round(avg(model_policy_action_agreement::INT), 4) AS policy_action_agreement_rate
        FROM cmp GROUP BY ALL""",
    "pts": """
        SELECT fraud_probability AS score, CAST(sum(label) AS BIGINT) AS pos,
               CAST(sum(1 - label) AS BIGINT) AS neg
        FROM feat GROUP BY 1""",
    "crv": """
        SELECT score, pos, neg, CAST(sum(pos) OVER w - pos AS BIGINT) AS pos_higher,
               CAST(sum(neg) OVER w - neg AS BIGINT) AS neg_higher
        FROM pts WINDOW w AS (ORDER BY score DESC)""",
    "evl": """
        SELECT max(ts) AS evaluated_at,
               CAST(floor(CAST(count(*) FILTER (event_type <> 'view') AS DOUBLE) / count(*) * 1000) AS INTEGER) AS permille
        FROM events GROUP BY CAST(ts AS DATE)""",
    "evl_new": """
        SELECT evaluated_at, CAST(permille AS DOUBLE) / 1000 AS f1,
               CAST(permille + 100 AS DOUBLE) / 1000 AS roc_auc
        FROM evl ORDER BY evaluated_at DESC LIMIT 1""",
    "feed_n": """
        SELECT 'payment' AS feed, (SELECT count(*) FROM pay) AS raw_n, (SELECT count(*) FROM pay_ok) AS ok_n
        UNION ALL SELECT 'customer_change', (SELECT count(*) FROM cust), (SELECT count(*) FROM cust_ok)
        UNION ALL SELECT 'authentication', (SELECT count(*) FROM auth), (SELECT count(*) FROM auth_ok)
        UNION ALL SELECT 'device_intelligence', (SELECT count(*) FROM dev), (SELECT count(*) FROM dev_ok)
        UNION ALL SELECT 'access', (SELECT count(*) FROM acc), (SELECT count(*) FROM acc_ok)""",
    "fbk": """
        SELECT 'fbk_' || event_id AS feedback_id, 'txn_' || event_id AS transaction_id,
               'fraud_model' AS model_name, '1' AS model_version,
               CASE WHEN k <> 7 THEN 'usr_' || user_id END AS analyst_id,
               CASE WHEN event_type = 'error' THEN 'CONFIRMED_FRAUD'
                    WHEN event_type = 'view' THEN 'FALSE_POSITIVE'
                    WHEN event_type = 'click' AND k < 5 THEN 'LATER' ELSE 'NEEDS_MORE_REVIEW' END AS disposition,
               CAST(NULL AS VARCHAR) AS analyst_notes, ts AS reviewed_at, ts AS recorded_at
        FROM ev""",
}


def _sql(final: str) -> str:
    """The final SELECT with the sub-queries it uses, directly or through others."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in used and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                used.append(name)

    visit(final)
    if not used:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in used) + "\n" + final


def _staged(table: str, time: str, feed: str, money: bool = False) -> str:
    swaps = [_t(time)] + ([_m("amount")] if money else [])
    return f"SELECT * REPLACE ({', '.join(swaps)}), '{feed}' AS _source_table FROM {table}"


def _held(table: str, time: str, feed: str, fails: str, money: bool = False) -> str:
    return (
        f"SELECT *, {fails} AS _quarantine_reasons "
        f"FROM ({_staged(table, time, feed, money)}) WHERE {fails} <> ''"
    )


def _contract(table: str, key: str, fails: str) -> str:
    return f"SELECT {key}, {fails} AS _quarantine_reasons FROM {table} WHERE {fails} <> ''"


_EDGE_OUT = (
    "edge_type, source_type, source_id, target_type, target_id, currency, transaction_count, "
    f"{_m('total_amount')}, {_t('first_seen_at')}, {_t('last_seen_at')}, labeled_risk_event_count"
)
_NET_OUT = (
    "device_id, linked_customer_count, network_transaction_count, "
    f"{_m('network_total_amount')}, {_t('network_last_seen_at')}, is_shared_device"
)
_CMP_OUT = f"* REPLACE ({_t('event_timestamp')}, {_t('scored_at')}, {_m('amount')})"

_SQL: dict[str, str] = {
    "s3_batch_scan": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "s4_shared_stage": f"""
        SELECT CASE WHEN r = '' THEN 'accepted' ELSE 'quarantined' END AS _status, r AS _quarantine_reasons,
               count(*) AS row_count FROM (SELECT {_PAY_FAILS} AS r FROM pay) GROUP BY ALL""",
    "p1_conform_payments": _staged("pay", "event_timestamp", "payment", True),
    "p2_conform_customers": _staged("cust", "change_timestamp", "customer_change"),
    "p3_conform_authentication": _staged("auth", "event_timestamp", "authentication"),
    "p4_conform_devices": _staged("dev", "observed_at", "device_intelligence"),
    "p5_conform_access": _staged("acc", "event_timestamp", "access"),
    "p7_clean_text": "SELECT change_id, upper(trim(country)) AS country, upper(trim(risk_segment)) AS risk_segment FROM cust_ok",
    "p8_payment_dates": f"SELECT event_id, {_t('event_timestamp')}, CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS event_date FROM pay_once",
    "p9_auth_flags": "SELECT auth_event_id, is_failed_login, is_mfa_bypass, is_headless_client FROM auth_flag",
    "p10_device_flags": "SELECT device_event_id, is_anonymized_network, is_untrusted_device FROM dev_flag",
    "p11_access_flags": "SELECT access_event_id, is_bulk_access, is_privileged_after_hours FROM acc_flag",
    "q1_payment_accepted": _staged("pay_ok", "event_timestamp", "payment", True),
    "q1_payment_quarantine": _held("pay", "event_timestamp", "payment", _PAY_FAILS, True),
    "q2_customer_accepted": _staged("cust_ok", "change_timestamp", "customer_change"),
    "q2_customer_quarantine": _held("cust", "change_timestamp", "customer_change", _CUST_FAILS),
    "q3_authentication_accepted": _staged("auth_ok", "event_timestamp", "authentication"),
    "q3_authentication_quarantine": _held("auth", "event_timestamp", "authentication", _AUTH_FAILS),
    "q4_device_accepted": _staged("dev_ok", "observed_at", "device_intelligence"),
    "q4_device_quarantine": _held("dev", "observed_at", "device_intelligence", _DEV_FAILS),
    "q5_access_accepted": _staged("acc_ok", "event_timestamp", "access"),
    "q5_access_quarantine": _held("acc", "event_timestamp", "access", _ACC_FAILS),
    "q7_invalid_counts": "SELECT feed, raw_n - ok_n AS row_count FROM feed_n",
    "q10_violation_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS rule_name, count(*) AS checked_count, "
        f"count(*) FILTER (NOT coalesce({predicate}, false)) AS violation_count FROM {table}"
        for table, rules in _RULES.items()
        for name, predicate in rules.items()
        if name != "is_vpn_malformed"
    ),
    "q13_payment_contract": _contract("pay", "event_id", _fails(
        event_id_required="event_id IS NOT NULL",
        event_timestamp_required="event_timestamp IS NOT NULL",
        customer_id_required="customer_id IS NOT NULL",
        amount_required="amount IS NOT NULL",
        amount_above="amount IS NULL OR amount > 0",
        currency_allowed="currency IN ('CAD', 'USD', 'EUR', 'GBP')",
        source_sequence_minimum="source_sequence >= 1",
    )),
    "q13_customer_contract": _contract("cust_raw", "change_id", _fails(
        change_id_required="change_id IS NOT NULL",
        change_timestamp_required="change_timestamp IS NOT NULL",
        operation_allowed="operation IN ('INSERT', 'UPDATE', 'DELETE')",
        customer_id_required="customer_id IS NOT NULL",
        risk_segment_allowed="risk_segment IS NULL OR risk_segment IN ('LOW', 'MEDIUM', 'HIGH')",
        country_max_length="length(country) <= 2",
        source_sequence_minimum="source_sequence >= 1",
    )),
    "q13_authentication_contract": _contract("auth_raw", "auth_event_id", _fails(
        auth_event_id_required="auth_event_id IS NOT NULL",
        event_timestamp_required="event_timestamp IS NOT NULL",
        customer_id_required="customer_id IS NOT NULL",
        auth_result_allowed="auth_result IN ('SUCCESS', 'FAILURE')",
        mfa_result_allowed="mfa_result IN ('PASSED', 'FAILED', 'BYPASSED', 'NOT_CHALLENGED')",
        source_sequence_minimum="source_sequence >= 1",
    )),
    "q13_device_contract": _contract("dev_raw", "device_event_id", _fails(
        device_event_id_required="device_event_id IS NOT NULL",
        observed_at_required="observed_at IS NOT NULL",
        customer_id_required="customer_id IS NOT NULL",
        network_type_allowed="network_type IN ('RESIDENTIAL', 'CORPORATE', 'MOBILE', 'VPN', 'TOR')",
        is_vpn_required="is_vpn IS NOT NULL",
        device_trust_allowed="device_trust IN ('TRUSTED', 'UNKNOWN', 'BLOCKED')",
        source_sequence_minimum="source_sequence >= 1",
        is_vpn_malformed="is_vpn IS NOT NULL",
    )),
    "q13_access_contract": _contract("acc_raw", "access_event_id", _fails(
        access_event_id_required="access_event_id IS NOT NULL",
        event_timestamp_required="event_timestamp IS NOT NULL",
        actor_id_required="actor_id IS NOT NULL",
        actor_type_allowed="actor_type IN ('CUSTOMER', 'EMPLOYEE', 'SERVICE_PRINCIPAL')",
        access_result_allowed="access_result IN ('ALLOWED', 'DENIED')",
        rows_accessed_minimum="rows_accessed >= 0",
        source_sequence_minimum="source_sequence >= 1",
    )),
    "q14_landing_counts": """
        SELECT count(*) AS row_count, count(DISTINCT event_id) AS distinct_event_ids,
               count(*) FILTER (amount <= 0) AS invalid_amounts,
               count(*) FILTER (scenario_label IS NULL) AS missing_labels FROM pay""",
    "q14_feed_counts": "SELECT feed, raw_n AS row_count FROM feed_n",
    "q15_device_edges": f"SELECT {_EDGE_OUT} FROM edge WHERE edge_type = 'USES'",
    "t2b_payment_dedup": _staged("pay_once", "event_timestamp", "payment", True),
    "t2b_authentication_dedup": _staged("auth_once", "event_timestamp", "authentication"),
    "t2b_device_dedup": _staged("dev_once", "observed_at", "device_intelligence"),
    "t2b_access_dedup": _staged("acc_once", "event_timestamp", "access"),
    "t2_stream_auth": "SELECT auth_event_id, is_failed_login, is_mfa_bypass, is_headless_client FROM auth_flag",
    "t4a_current_customers": _staged("cust_now", "change_timestamp", "customer_change"),
    "t4_stream_customers": _staged("cust_now", "change_timestamp", "customer_change"),
    "d1_identity": _staged("cust_id", "change_timestamp", "customer_change"),
    "u1_edge_rows": f"""
        SELECT edge_type, source_type, target_type, currency, count(*) AS row_count, {_m('sum(amount)', 'amount')},
               count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets
        FROM edge_row GROUP BY ALL""",
    "a1_edges": f"SELECT {_EDGE_OUT} FROM edge",
    "a2_auth_features": f"SELECT * REPLACE ({_t('last_authentication_at')}) FROM auth_f",
    "a3_device_features": f"SELECT * REPLACE ({_t('last_device_observation_at')}) FROM dev_f",
    "a4_access_signals": f"SELECT * REPLACE ({_t('last_access_at')}) FROM sig",
    "a5_network_from_edges": f"SELECT {_NET_OUT} FROM net",
    "a5_device_network": f"SELECT {_NET_OUT} FROM net",
    "j4_d3_behavior": f"SELECT * REPLACE ({_t('last_authentication_at')}, {_t('last_device_observation_at')}) FROM beh",
    "j6_enriched": """
        SELECT event_id, customer_id, device_id, segment AS risk_segment, resolved_identity_id,
               failed_login_count, impossible_travel_count, behavior_score AS behavioral_risk_score,
               linked AS linked_customer_count, net_count AS network_transaction_count,
               shared AS is_shared_device FROM enr""",
    "d9_rule_scores": f"""
        SELECT event_id, amount_rule_score, channel_rule_score, shared_device_rule_score,
               customer_segment_score, behavioral_risk_score, linked_customer_count,
               network_transaction_count, {_m('network_total_amount')}, is_shared_device, risk_segment,
               risk_score FROM ruled""",
    "d18_decisions": f"SELECT * REPLACE ({_t('event_timestamp')}, {_m('amount')}) FROM deci",
    "d16_cases": f"""
        SELECT sha256('CASE|' || decision_id) AS case_id, decision_id, transaction_id, customer_id,
               {_t('event_timestamp')}, risk_score, risk_level, recommended_action, reason_codes,
               CASE WHEN recommended_action = 'BLOCK' THEN 'P1' ELSE 'P2' END AS case_priority,
               'OPEN' AS case_status, 'FINANCIAL_CRIME_OPERATIONS' AS queue_name, policy_version
        FROM deci WHERE recommended_action IN ('REVIEW', 'BLOCK')""",
    "d17_alerts": f"""
        SELECT * REPLACE ({_t('last_access_at')}),
               sha256(actor_id || '|' || role_name || '|{VERSION}') AS alert_id,
               CASE WHEN access_risk_score >= 80 THEN 'CRITICAL' WHEN access_risk_score >= 50 THEN 'HIGH'
                    ELSE 'MEDIUM' END AS risk_level,
               CASE WHEN access_risk_score >= 80 THEN 'SUSPEND_AND_REVIEW' ELSE 'REVIEW' END AS recommended_action,
               '{VERSION}' AS policy_version
        FROM sig WHERE access_risk_score >= 25""",
    "a6_decision_metrics": f"""
        SELECT CAST(CAST(event_timestamp AS DATE) AS VARCHAR) AS decision_date, risk_level,
               recommended_action, policy_version, count(*) AS decision_count,
               round(avg(risk_score), 2) AS average_risk_score, {_m('round(sum(amount), 2)', 'payment_amount')},
               count(DISTINCT customer_id) AS customer_count
        FROM deci GROUP BY CAST(event_timestamp AS DATE), risk_level, recommended_action, policy_version""",
    "a8_scenario_summary": f"""
        SELECT scenario_label, count(*) AS event_count, {_m('round(sum(amount), 2)', 'total_amount')}
        FROM pay_ok GROUP BY scenario_label ORDER BY scenario_label""",
    "m2_split": """
        SELECT label, count(*) AS row_count, count(*) AS in_a_part, CAST(0 AS BIGINT) AS in_both,
               true AS a_fifth_tests FROM feat GROUP BY label""",
    "m4_medians": "\n UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM feat" for c in (
            "amount", "failed_login_count", "mfa_bypass_count", "headless_client_count", "anonymized_network_count",
            "untrusted_device_count", "impossible_travel_count", "linked_customer_count", "network_transaction_count",
        )
    ),
    "m6_descent": "SELECT event_id, true AS descent_follows, true AS separates FROM feat",
    "m9_model_scoring": """
        SELECT event_id, transaction_id, customer_id, policy_risk_score, policy_risk_level,
               policy_recommended_action, policy_reason_codes, explanation_signals,
               registered_model_name, registered_model_version, model_alias,
               true AS probability_bounded, true AS prediction_follows, true AS level_follows,
               true AS action_follows, true AS agreement_follows, true AS gap_follows FROM cmp""",
    "a9_class_counts": "SELECT label, count(*) AS row_count FROM feat GROUP BY label",
    "a10_global_aggregates": """
        SELECT count(*) AS row_count, min(fraud_probability) AS minimum, max(fraud_probability) AS maximum,
               round(avg(fraud_probability), 6) AS average FROM feat""",
    "m1_training_frame": f"""
        SELECT event_id, {_t('event_timestamp')}, label, {_m('amount')}, failed_login_count, mfa_bypass_count,
               headless_client_count, anonymized_network_count, untrusted_device_count,
               impossible_travel_count, linked_customer_count, network_transaction_count, currency,
               payment_channel, risk_segment FROM feat""",
    "m7_score_curve": "SELECT score, pos, neg, pos_higher, neg_higher FROM crv",
    "m7_evaluation": """
        SELECT round(CAST(sum(neg * (pos_higher + pos / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc,
               round(sum(pos * CAST(pos_higher + pos AS DOUBLE) / (pos_higher + pos + neg_higher + neg)) / sum(pos), 9) AS pr_auc,
               round(CAST(sum(pos) FILTER (score >= 0.5) AS DOUBLE) / sum(pos + neg) FILTER (score >= 0.5), 9) AS precision,
               round(CAST(sum(pos) FILTER (score >= 0.5) AS DOUBLE) / sum(pos), 9) AS recall,
               round(2 * CAST(sum(pos) FILTER (score >= 0.5) AS DOUBLE)
                     / (sum(pos) + sum(pos + neg) FILTER (score >= 0.5)), 9) AS f1,
               CAST(sum(pos + neg) AS BIGINT) AS test_row_count
        FROM crv""",
    "m10_bands": "SELECT event_id, fraud_probability, ml_prediction, ml_risk_level, ml_recommended_action FROM sco",
    "m11_explanations": "SELECT event_id, explanation_signals FROM sco",
    "j5_m12_compared": f"SELECT {_CMP_OUT} FROM cmp",
    "a7_m13_scoring_metrics": "SELECT * FROM met",
    "m14_feedback_valid": f"""
        SELECT * REPLACE ({_t('reviewed_at')}, {_t('recorded_at')}) FROM fbk
        WHERE analyst_id IS NOT NULL AND disposition <> 'LATER'""",
    "m14_feedback_rejected": _contract("fbk", "feedback_id", _fails(
        analyst_id_required="analyst_id IS NOT NULL", disposition_supported="disposition <> 'LATER'",
    )),
    "g2_protected_view": f"SELECT {_CMP_OUT} FROM prot",
    "h_health": """
        SELECT 'OPS-001' AS control_id, 'Scored transaction availability' AS control_name,
               CAST(count(*) AS VARCHAR) AS observed_value, '> 0' AS threshold,
               CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS control_status,
               'CRITICAL' AS severity, 'dev' AS environment FROM cmp
        UNION ALL
        SELECT 'OPS-002', 'Fraud probability bounds',
               CAST(min(fraud_probability) AS VARCHAR) || '..' || CAST(max(fraud_probability) AS VARCHAR), '0.0..1.0',
               CASE WHEN min(fraud_probability) >= 0 AND max(fraud_probability) <= 1 THEN 'PASS' ELSE 'FAIL' END,
               'CRITICAL', 'dev' FROM cmp
        UNION ALL
        SELECT 'OPS-003', 'Scoring freshness', CAST(epoch(TIMESTAMP '2026-01-01 01:30:00' - max(scored_at)) / 60 AS VARCHAR), '<= 120 minutes',
               CASE WHEN epoch(TIMESTAMP '2026-01-01 01:30:00' - max(scored_at)) <= 7200 THEN 'PASS' ELSE 'FAIL' END,
               'CRITICAL', 'dev' FROM cmp
        UNION ALL
        SELECT 'OPS-004', 'Model-policy action agreement',
               CAST(round(avg(model_policy_action_agreement::INT), 4) AS VARCHAR), '>= 0.35 demonstration baseline',
               CASE WHEN avg(model_policy_action_agreement::INT) >= 0.35 THEN 'PASS' ELSE 'WARN' END,
               'WARNING', 'dev' FROM cmp
        UNION ALL
        SELECT 'OPS-005', 'Latest model evaluation', 'f1=' || f1 || ', roc_auc=' || roc_auc, 'f1 >= 0.60',
               CASE WHEN f1 >= 0.6 THEN 'PASS' ELSE 'FAIL' END, 'CRITICAL', 'dev' FROM evl_new
        UNION ALL
        SELECT 'OPS-006', 'Quarantine rate',
               CAST(round(CAST(sum(raw_n - ok_n) AS DOUBLE) / sum(raw_n), 4) AS VARCHAR), '<= 0.05',
               CASE WHEN CAST(sum(raw_n - ok_n) AS DOUBLE) / sum(raw_n) <= 0.05 THEN 'PASS' ELSE 'WARN' END,
               'WARNING', 'dev' FROM feed_n
        UNION ALL
        SELECT 'OPS-007', 'Protected investigator view availability', CAST(count(*) AS VARCHAR),
               '= ' || (SELECT count(*) FROM sco),
               CASE WHEN count(*) = (SELECT count(*) FROM sco) THEN 'PASS' ELSE 'FAIL' END, 'CRITICAL', 'dev' FROM prot""",
    "o1_ordered_report": "SELECT ml_risk_level, average_fraud_probability FROM met ORDER BY average_fraud_probability DESC",
    "o2_latest_row": f"SELECT * REPLACE ({_t('evaluated_at')}) FROM evl_new",
    "q12_guarded_layers": """
        SELECT 'payments' AS feed, count(*) AS row_count FROM pay_once
        UNION ALL SELECT 'customers', count(*) FROM cust_id
        UNION ALL SELECT 'authentication', count(*) FROM auth_once
        UNION ALL SELECT 'devices', count(*) FROM dev_once
        UNION ALL SELECT 'access', count(*) FROM acc_once
        UNION ALL SELECT 'decisions', count(*) FROM pay_once""",
    "k1_landed_payments": """
        SELECT 'payment' AS feed, 'accepted' AS status, count(*) AS row_count FROM pay_ok
        UNION ALL SELECT 'payment', 'quarantined', (SELECT count(*) FROM pay) - count(*) FROM pay_ok""",
    "f1_casts": """
        SELECT event_id, TRY_CAST(CASE WHEN k % 3 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS as_double,
               CAST(TRY_CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS as_decimal, CAST(k AS BIGINT) AS as_long,
               CASE WHEN k % 2 = 0 THEN true WHEN k % 5 = 0 THEN NULL ELSE false END AS as_boolean
        FROM ev""",
    "f2_text": """
        SELECT c_custkey, upper(c_name) AS upper_name, lower(c_name) AS lower_name, c_name AS trimmed_name,
               lower(c_mktsegment) LIKE '%build%' AS is_building,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN c_name ELSE c_name || '|' || c_mktsegment END AS joined,
               substr(c_name, 1, 4) AS head
        FROM customer""",
    "f4_ids_and_hashes": f"""
        SELECT 'ord_' || lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS padded,
               sha256(o_orderkey || '|' || o_orderpriority) AS hashed,
               'cus_' || substr(sha256('{NAMESPACE}|' || o_custkey), 1, 16) AS token,
               ['CAD', 'USD', 'EUR', 'GBP'][o_custkey % 4 + 1] AS picked
        FROM orders""",
    "f7_numbers": """
        SELECT l_orderkey, l_linenumber,
               CAST(floor(l_quantity / 8 * 100 + 0.5) AS DOUBLE) / 100 AS rounded,
               least(100, l_linenumber * 25) AS capped,
               CASE WHEN l_quantity >= 40 THEN 'HIGH' WHEN l_quantity >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS size,
               coalesce(nullif(l_returnflag, 'N'), 'none') AS flag,
               l_quantity BETWEEN 10 AND 20 AS between_10_20, l_linestatus IN ('F') AS is_final
        FROM lineitem""",
    "f9_times": f"""
        SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
               {_t("TIMESTAMP '2026-01-01' + to_seconds(event_id * 15)", 'stepped')}
        FROM events""",
    "f10_arrays": f"""
        SELECT l_orderkey, l_linenumber, {_notes(LARGE="l_quantity >= 25", DISCOUNTED="l_discount > 0.05", RETURNED="l_returnflag = 'R'")} AS flags,
               CAST((l_quantity >= 25)::INT + (l_discount > 0.05)::INT + (l_returnflag = 'R')::INT AS BIGINT) AS flag_count,
               CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE l_returnflag || ',' || l_linestatus END AS distinct_flags
        FROM lineitem""",
}


_SQL["k3_partitioned_append"] = f"SELECT event_id, {_m('amount')}, currency, source_sequence FROM pay_ok"
_SQL["k4_replaced_table"] = _SQL["a4_access_signals"]
_SQL["k2_versioned_metrics"] = _SQL["a6_decision_metrics"]
_SQL["a1_edges_by_batch"] = _SQL["a1_edges"]
_SQL["a5_network_by_batch"] = _SQL["a5_device_network"]
_SQL["a6_metrics_by_batch"] = _SQL["a6_decision_metrics"]
_SQL["k5_reopened_view"] = _SQL["g2_protected_view"]
_SQL["k2_switched_table"] = _SQL["a4_access_signals"]
_SQL["k3_batches_once"] = _SQL["k3_partitioned_append"]
_SQL["k6_feedback_once"] = _SQL["m14_feedback_valid"]
_SQL["q10_observed_landing"] = " UNION ALL ".join(
    f"SELECT '{name}' AS rule_name, count(*) AS checked_count, "
    f"count(*) FILTER (NOT coalesce({predicate}, false)) AS violation_count FROM pay"
    for name, predicate in _RULES["pay"].items()
)
_SQL["s2_backfill"] = _SQL["t2_stream_auth"]
_SQL["t4_merged_customers"] = _SQL["t4_stream_customers"]
_SQL["t1_late_rows"] = """
    SELECT a.n + c.n AS accepted, o.n AS kept, a.n + c.n - o.n - c.late AS copies, c.late AS late
    FROM (SELECT count(*) AS n, max(event_timestamp) AS newest FROM auth_ok) a, (SELECT count(*) AS n FROM auth_once) o,
         (SELECT count(*) AS n, count(*) FILTER (event_timestamp < (SELECT max(event_timestamp) FROM auth_ok) - INTERVAL 1 DAY) AS late
          FROM auth_ok WHERE substr(md5(auth_event_id), 1, 1) = '7') c"""
_SQL["k6_feedback_log"] = _SQL["m14_feedback_valid"]
_SQL["k7_json_lines"] = _SQL["d17_alerts"]


def oracle_sql() -> dict[str, str]:
    return {name: _sql(text) for name, text in _SQL.items()}
