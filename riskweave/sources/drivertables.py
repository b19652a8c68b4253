"""The five feeds derived from the driver's tables.

``lineitem`` joined with ``orders`` gives payments, ``events`` gives the other four.
Rules are in FIXTURES.md. Every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.columns import cycle


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _broken(n: int, key: str = "l_orderkey") -> str:
    """A few rows, others for each n, that lack a value a rule asks for."""
    return f"{key} % 997 = {n}"


def _event_columns(prefix: str, key: str, time: str, party: str, party_value: str) -> list[str]:
    """Columns that every event feed has: id, time and party, absent in a few rows, and a
    sequence that is not positive in a few."""
    b = [_broken(n, "event_id") for n in range(5)]
    return [
        f"CASE WHEN {b[1]} THEN NULL ELSE concat('{prefix}', event_id) END AS {key}",
        f"CASE WHEN {b[2]} THEN NULL ELSE timestamp(ts) END AS {time}",
        f"CASE WHEN {b[3]} THEN NULL ELSE {party_value} END AS {party}",
        f"CASE WHEN {b[4]} THEN -1L ELSE event_id + 1 + copy * 1000000 END AS source_sequence",
        "true AS is_synthetic",
    ]


def _sent_again(events: DataFrame) -> DataFrame:
    """Events with ``copy``: some are delivered twice, the second time with a later sequence."""
    return events.withColumn("copy", F.expr("explode(sequence(0L, if(event_id % 25 = 0, 1L, 0L)))"))


def _some_lower(value: str) -> str:
    """The value as its contract has it, but for a tenth of the rows in lower case."""
    return f"CASE WHEN k % 10 = 3 THEN lower({value}) ELSE {value} END"


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join is a sort-merge join, as it is for tables of any real size. Asking for it
    also spreads the rows by order before the text columns are built, so a table stored
    in few row groups does not leave that work to as few tasks."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge")
    lines = _read(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    return lines.selectExpr(
        f"CASE WHEN {_broken(1)} THEN NULL ELSE concat('evt_', l_orderkey, '_', l_linenumber) END AS event_id",
        f"CASE WHEN {_broken(2)} THEN NULL ELSE timestamp(l_shipdate) END AS event_timestamp",
        "concat('txn_', l_orderkey, '_', l_linenumber) AS transaction_id",
        f"CASE WHEN {_broken(3)} THEN NULL ELSE concat('cus_', o_custkey) END AS customer_id",
        "concat('acc_', o_custkey) AS account_id",
        "concat('mer_', l_suppkey) AS merchant_id",
        "concat('dev_', l_partkey, '_', l_linenumber) AS device_id",
        "concat('10.0.0.', l_suppkey % 250 + 1) AS ip_address",
        """CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN NULL
                WHEN l_suppkey % 40 = 1 AND l_linenumber = 6 THEN -1D
                ELSE l_quantity * 40 + l_linenumber END AS amount""",
        f"""CASE WHEN l_suppkey % 50 = 0 THEN 'XXX'
                 ELSE {cycle(("CAD", "USD", "EUR", "GBP"), "l_suppkey")} END AS currency""",
        f"{cycle(('CARD_PRESENT', 'ECOMMERCE', 'MOBILE', 'TRANSFER'), 'l_linenumber')} AS payment_channel",
        "CASE WHEN l_linenumber % 4 = 3 THEN 'TRANSFER' ELSE 'AUTHORISATION' END AS event_type",
        f"CASE WHEN {_broken(4)} THEN -1L ELSE l_partkey * 100000 + l_suppkey + 1 END AS source_sequence",
        "true AS is_synthetic",
        "CASE WHEN l_returnflag = 'R' THEN 'PAYMENT_FRAUD' ELSE 'LEGITIMATE' END AS scenario_label",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(_read(spark, sf_dir, "events"))


def with_k(events: DataFrame) -> DataFrame:
    """Events with the number in their property text. Works on streams too."""
    return events.withColumn(
        "k", F.expr("""cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS int)""")
    )


def customer_changes_of(events: DataFrame) -> DataFrame:
    operation = """CASE WHEN event_type = 'signup' THEN 'INSERT'
                WHEN event_type = 'error' AND k < 50 THEN 'DELETE'
                WHEN event_type = 'view' AND k = 51 THEN 'MERGE' ELSE 'UPDATE' END"""
    return events.withColumn("copy", F.lit(0)).selectExpr(
        *_event_columns("chg_", "change_id", "change_timestamp", "customer_id", "concat('cus_', user_id)"),
        f"{_some_lower(operation)} AS operation",
        """CASE WHEN k = 13 THEN NULL WHEN k % 22 = 0 THEN ' high '
                WHEN k % 11 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_segment""",
        f"{cycle(('CA', 'us ', 'GB', 'DE'), 'k')} AS country",
        "CASE WHEN k % 7 <> 0 THEN sha2(string(user_id), 256) END AS email_hash",
        "CASE WHEN k % 5 <> 0 THEN sha2(string(user_id), 256) END AS phone_hash",
    )


def authentication_of(events: DataFrame) -> DataFrame:
    failed = "(event_type = 'error' AND k < 8)"
    bypassed = "(event_type = 'signup' AND k < 1)"
    result = f"""CASE WHEN {failed} THEN 'FAILURE'
                 WHEN event_type = 'purchase' AND k = 50 THEN 'TIMEOUT' ELSE 'SUCCESS' END"""
    challenge = f"""CASE WHEN {bypassed} THEN 'BYPASSED' WHEN {failed} THEN 'NOT_CHALLENGED'
                 ELSE 'PASSED' END"""
    return _sent_again(events).selectExpr(
        *_event_columns("auth_", "auth_event_id", "event_timestamp", "customer_id", "concat('cus_', user_id)"),
        "concat('acc_', user_id) AS account_id",
        "concat('ses_', event_id) AS session_id",
        "concat('dev_', k) AS device_id",
        "concat('10.1.0.', event_id % 50) AS ip_address",
        "'ca' AS country",
        "'Toronto' AS city",
        f"{_some_lower(result)} AS auth_result",
        f"CASE WHEN {failed} THEN 'INVALID_PASSWORD' END AS failure_reason",
        f"{_some_lower(challenge)} AS mfa_result",
        """CASE WHEN event_type = 'view' AND k < 2 THEN 'HeadlessClient/1.0'
                ELSE 'Browser/1.0' END AS user_agent""",
        f"""CASE WHEN {failed} THEN 'BRUTE_FORCE' WHEN {bypassed} THEN 'ACCOUNT_TAKEOVER'
                 ELSE 'LEGITIMATE' END AS scenario_label""",
    )


def device_of(events: DataFrame) -> DataFrame:
    """Every event observes a device. Customers are numbered 7 higher than in the other feeds,
    so that some have observations and no sign-in and some the other way round; ``is_vpn``
    arrives as text and is not always readable."""
    network = """CASE WHEN k = 98 THEN 'VPN' WHEN k = 99 THEN 'TOR' WHEN k = 50 THEN 'SATELLITE'
                ELSE 'RESIDENTIAL' END"""
    return _sent_again(events).selectExpr(
        *_event_columns("dvi_", "device_event_id", "observed_at", "customer_id", "concat('cus_', user_id + 7)"),
        "concat('dev_', k) AS device_id",
        "concat('10.2.0.', event_id % 50) AS ip_address",
        "CASE WHEN k = 96 THEN 'sg' ELSE 'ca' END AS country",
        "CASE WHEN k = 96 THEN 'Singapore' ELSE 'Toronto' END AS city",
        "CASE WHEN k = 96 THEN 1.3521D ELSE 43.6532D END AS latitude",
        "CASE WHEN k = 96 THEN 103.8198D ELSE -79.3832D END AS longitude",
        f"{_some_lower(network)} AS network_type",
        "CASE WHEN k = 98 THEN 'true' WHEN k = 51 THEN 'maybe' ELSE 'false' END AS is_vpn",
        "k = 99 AS is_tor",
        f"""{_some_lower("CASE WHEN k >= 97 THEN 'UNKNOWN' ELSE 'TRUSTED' END")} AS device_trust""",
        """CASE WHEN k = 96 THEN 'IMPOSSIBLE_TRAVEL' WHEN k >= 98 THEN 'ANONYMIZED_NETWORK'
                ELSE 'LEGITIMATE' END AS scenario_label""",
    )


def access_of(events: DataFrame) -> DataFrame:
    result = "CASE WHEN event_type = 'error' AND k = 60 THEN 'FAILED' ELSE 'ALLOWED' END"
    return _sent_again(events).selectExpr(
        *_event_columns("acs_", "access_event_id", "event_timestamp", "actor_id", "concat('usr_', user_id)"),
        f"""{_some_lower("'EMPLOYEE'")} AS actor_type""",
        "event_type AS role_name",
        "concat('10.3.0.', user_id % 250) AS source_ip",
        "'CASE' AS resource_type",
        "'case_table' AS resource_name",
        "'READ' AS action",
        f"{_some_lower(result)} AS access_result",
        """CASE WHEN event_type = 'view' AND k = 50 THEN -1L
                ELSE bigint(round(value * 100)) div 2 END AS rows_accessed""",
        "event_type = 'purchase' AS privileged_access",
        "hour(ts) < 1 AS outside_business_hours",
        """CASE WHEN event_type = 'purchase' AND hour(ts) < 1 THEN 'PRIVILEGED_ABUSE'
                ELSE 'LEGITIMATE' END AS scenario_label""",
    )


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_changes_of(_events(spark, sf_dir))


def authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authentication_of(_events(spark, sf_dir))


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_of(_events(spark, sf_dir))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_of(_events(spark, sf_dir))
