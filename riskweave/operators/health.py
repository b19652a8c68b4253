"""Operational health checks as one small DataFrame.

Each table is read once: its checks share one aggregate, which is then unfolded into
one row per check.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.evaluation import latest_evaluation
from riskweave.operators.expectations import STATUS

# --- Fixed values: check limits
MAX_AGE_MINUTES = 120
MIN_AGREEMENT = 0.35
MIN_F1 = 0.60
MAX_QUARANTINE_RATE = 0.05
# --- End of fixed values -----------------------------------------------------------


def _check(control_id, name, observed: Column, limit: Column | str, passed: Column, severity) -> Column:
    """One check. A condition that is NULL did not pass."""
    failed = "FAIL" if severity == "CRITICAL" else "WARN"
    return F.struct(
        F.lit(control_id).alias("control_id"),
        F.lit(name).alias("control_name"),
        F.coalesce(observed.cast("string"), F.lit("missing")).alias("observed_value"),
        (F.lit(limit) if isinstance(limit, str) else limit).alias("threshold"),
        F.when(passed, F.lit("PASS")).otherwise(F.lit(failed)).alias("control_status"),
        F.lit(severity).alias("severity"),
    )


def scored_checks(scored: DataFrame, now: Column) -> DataFrame:
    age = (F.unix_timestamp(now) - F.unix_timestamp("scored_at")) / 60
    stats = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("fraud_probability").alias("low"),
        F.max("fraud_probability").alias("high"),
        F.max(age).alias("age"),
        F.avg(F.col("model_policy_action_agreement").cast("double")).alias("agreement"),
    )
    n, low, high = F.col("n"), F.col("low"), F.col("high")
    agreement, minutes = F.col("agreement"), F.col("age")
    bounds = F.concat(low.cast("string"), F.lit(".."), high.cast("string"))
    return stats.select(
        F.inline(
            F.array(
                _check("OPS-001", "Scored transaction availability", n, "> 0", n > 0, "CRITICAL"),
                _check("OPS-002", "Fraud probability bounds", bounds, "0.0..1.0", (low >= 0) & (high <= 1), "CRITICAL"),
                _check("OPS-003", "Scoring freshness", F.round(minutes, 2), f"<= {MAX_AGE_MINUTES} minutes", minutes <= MAX_AGE_MINUTES, "CRITICAL"),
                _check("OPS-004", "Model-policy action agreement", F.round(agreement, 4), f">= {MIN_AGREEMENT} demonstration baseline", agreement >= MIN_AGREEMENT, "WARNING"),
            )
        )
    )


def evaluation_check(evaluations: DataFrame) -> DataFrame:
    # An aggregate without keys yields a row for an empty log too.
    newest = latest_evaluation(evaluations).agg(F.max("f1").alias("f1"), F.max("roc_auc").alias("roc_auc"))
    text = F.concat(F.lit("f1="), F.col("f1").cast("string"), F.lit(", roc_auc="), F.col("roc_auc").cast("string"))
    check = _check("OPS-005", "Latest model evaluation", text, f"f1 >= {MIN_F1:.2f}", F.col("f1") >= MIN_F1, "CRITICAL")
    return newest.select(F.inline(F.array(check)))


def quarantine_check(counts: DataFrame) -> DataFrame:
    """``counts``: rows of (status, row_count) over all feeds."""
    held = F.sum(F.when(F.col("status") == "quarantined", F.col("row_count")).otherwise(0))
    rate = (held / F.greatest(F.sum("row_count"), F.lit(1))).alias("rate")
    check = _check("OPS-006", "Quarantine rate", F.round("rate", 4), f"<= {MAX_QUARANTINE_RATE}", F.col("rate") <= MAX_QUARANTINE_RATE, "WARNING")
    return counts.agg(rate).select(F.inline(F.array(check)))


def view_check(scored: DataFrame, view: DataFrame) -> DataFrame:
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        for side, df in (("scored", scored), ("view", view))
    ]
    both = sizes[0].unionByName(sizes[1]).agg(
        F.max(F.when(F.col("side") == "scored", F.col("n"))).alias("scored"),
        F.max(F.when(F.col("side") == "view", F.col("n"))).alias("seen"),
    )
    limit = F.concat(F.lit("= "), F.col("scored").cast("string"))
    check = _check("OPS-007", "Protected investigator view availability", F.col("seen"), limit, F.col("seen") == F.col("scored"), "CRITICAL")
    return both.select(F.inline(F.array(check)))


def status_counts(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Accepted and quarantined row counts per feed, from tagged rows: one scan a feed."""
    parts = [
        df.groupBy(F.col(STATUS).alias("status")).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("feed"), "status", "row_count"
        )
        for name, df in feeds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def health(
    scored: DataFrame,
    evaluations: DataFrame,
    counts: DataFrame,
    view: DataFrame,
    now: Column | None = None,
    environment: str = "dev",
) -> DataFrame:
    """All checks, one row each."""
    now = F.current_timestamp() if now is None else now
    parts = [
        scored_checks(scored, now),
        evaluation_check(evaluations),
        quarantine_check(counts),
        view_check(scored, view),
    ]
    return reduce(DataFrame.unionByName, parts).withColumns(
        {"checked_at": now, "environment": F.lit(environment)}
    )


def enforce(health_rows: DataFrame) -> None:
    """Raise when a critical check failed. Pass the stored results."""
    failed = health_rows.filter("control_status = 'FAIL' AND severity = 'CRITICAL'").count()
    if failed:
        raise RuntimeError(f"operational health: {failed} critical check(s) failed, see the stored results")
