"""Payment conforming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.functions.columns import with_expr

# Which copy of a re-sent payment is kept: lowest sequence, then earliest, then least. The
# columns after that are all that later layers read, so a plan that reads those alone and a
# stored table with every column keep the same copy.
PAYMENT_ORDER = (
    "source_sequence", "event_timestamp", "amount", "transaction_id", "customer_id", "account_id",
    "merchant_id", "device_id", "currency", "payment_channel", "scenario_label",
)


def payment_dates(payments: DataFrame) -> DataFrame:
    return with_expr(
        payments, event_date="to_date(event_timestamp)", _conformed_at="current_timestamp()"
    )
