"""Landing reconciliation and summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payment_landing_counts(payments: DataFrame) -> DataFrame:
    """One row of counts for a landing batch, in one pass."""
    return payments.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("event_id").alias("distinct_event_ids"),
        F.count_if(F.col("amount") <= 0).alias("invalid_amounts"),
        F.count_if(F.col("scenario_label").isNull()).alias("missing_labels"),
    )


def feed_counts(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per named frame, as one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("feed"), "row_count")
        for name, df in feeds.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def check_landing(
    payments: DataFrame, others: Mapping[str, DataFrame], expected: Mapping[str, int]
) -> None:
    """Raise when a landing batch is not what was sent."""
    seen = payment_landing_counts(payments).first()
    problems = []
    if seen["row_count"] != expected["payment"]:
        problems.append(f"payment: {seen['row_count']} rows, expected {expected['payment']}")
    if seen["distinct_event_ids"] != expected["payment"]:
        problems.append(f"payment: {seen['distinct_event_ids']} distinct event ids")
    if seen["invalid_amounts"] or seen["missing_labels"]:
        problems.append(
            f"payment: {seen['invalid_amounts']} bad amounts, {seen['missing_labels']} missing labels"
        )
    if others:
        for row in feed_counts(others).collect():
            if row["row_count"] != expected[row["feed"]]:
                problems.append(f"{row['feed']}: {row['row_count']} rows, expected {expected[row['feed']]}")
    if problems:
        raise ValueError("landing reconciliation failed: " + "; ".join(problems))


def scenario_summary(payments: DataFrame) -> DataFrame:
    """Events and amount per scenario, sorted by scenario."""
    return payments.groupBy("scenario_label").agg(
        F.count(F.lit(1)).alias("event_count"), F.round(F.sum("amount"), 2).alias("total_amount")
    ).orderBy("scenario_label")
