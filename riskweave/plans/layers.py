"""The layers over the driver's tables, each as one function of (spark, folder).

A layer is one plan from files to result, but for ``stored_enriched``, which stores the layers
below it. A production run stores each layer, see ``riskweave.plans.medallion``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.columns import with_expr
from riskweave.functions.conform import conform
from riskweave.operators import access as acc
from riskweave.operators import behavior as beh
from riskweave.operators import decisions as dec
from riskweave.operators import edges as edg
from riskweave.operators import model as mdl
from riskweave.operators.expectations import accepted, require
from riskweave.operators.identity import resolve_identity
from riskweave.operators.latest import current_customers, dedup_batch
from riskweave.operators.payments import PAYMENT_ORDER
from riskweave.settings import Settings
from riskweave.sources import drivertables as raw
from riskweave.sources import feeds
from riskweave.sources.readers import kept

SETTINGS = Settings(token_namespace="example-namespace")
RAW = {
    "payment": raw.payments,
    "customer_change": raw.customer_changes,
    "authentication": raw.authentication,
    "device_intelligence": raw.device,
    "access": raw.access,
}


def staged(spark: SparkSession, d: str, feed: str) -> DataFrame:
    return conform(RAW[feed](spark, d), feeds.FEEDS[feed], feed)


def as_sent(spark: SparkSession, d: str, feed: str) -> DataFrame:
    """Typed rows with the text as its source wrote it: what a contract is about."""
    return conform(RAW[feed](spark, d), feeds.FEEDS[feed], feed, as_sent=True)


def bronze(spark: SparkSession, d: str, feed: str) -> DataFrame:
    return accepted(staged(spark, d, feed), feeds.FEEDS[feed].rules)


def payments(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated payments with the columns that later layers use.

    Features and decisions read the same columns, so Spark runs the deduplication once
    and reuses its shuffle.
    """
    rows = bronze(spark, d, "payment").select(*dec.PAYMENT_INPUTS)
    return require(dedup_batch(rows, "event_id", PAYMENT_ORDER), feeds.PAYMENT_GUARD)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return require(
        resolve_identity(current_customers(bronze(spark, d, "customer_change"))),
        feeds.CUSTOMER_GUARD,
    )


def authentication(spark: SparkSession, d: str) -> DataFrame:
    rows = bronze(spark, d, "authentication").select(*beh.AUTH_INPUTS)
    once = dedup_batch(rows, "auth_event_id", beh.AUTH_ORDER)
    return beh.auth_flags(require(once, feeds.AUTHENTICATION_GUARD))


def devices(spark: SparkSession, d: str) -> DataFrame:
    rows = bronze(spark, d, "device_intelligence").select(*beh.DEVICE_INPUTS)
    once = dedup_batch(rows, "device_event_id", beh.OBSERVATION_ORDER)
    return beh.device_flags(require(once, feeds.DEVICE_GUARD))


def access(spark: SparkSession, d: str) -> DataFrame:
    rows = bronze(spark, d, "access").select(*acc.ACCESS_INPUTS)
    once = dedup_batch(rows, "access_event_id", acc.ACCESS_ORDER)
    return acc.access_flags(require(once, feeds.ACCESS_GUARD))


def behavior(spark: SparkSession, d: str) -> DataFrame:
    return beh.behavioral_features(authentication(spark, d), devices(spark, d))


def network(spark: SparkSession, d: str) -> DataFrame:
    return edg.device_network_of(payments(spark, d))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    paid = payments(spark, d)
    return dec.enrich(paid, customers(spark, d), behavior(spark, d), edg.device_network_of(paid))


def stored_enriched(spark: SparkSession, d: str, network: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """``enriched`` over stored payments and profiles, and device features stored as well or, by another
    ``network``, as they are. The shuffle files of a step go before the next one begins, so that the
    disk never holds those of all steps together."""
    paid = kept(payments(spark, d))
    profiles = kept(dec.customer_profiles(customers(spark, d), behavior(spark, d)))
    return dec.with_features(paid, profiles, network(edg.device_network_of(paid)))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return dec.decide(enriched(spark, d), SETTINGS)


def stored_decisions(spark: SparkSession, d: str) -> DataFrame:
    """``decisions`` over stored layers. They read one distinct count of the device features alone, which
    is less to move than all features are, so these stay in the plan that reads them."""
    return dec.decide(stored_enriched(spark, d, network=lambda rows: rows), SETTINGS)


def signals(spark: SparkSession, d: str) -> DataFrame:
    return acc.access_signals(access(spark, d))


def with_given_score(rows: DataFrame) -> DataFrame:
    """Payments with a label and a score that follows from the payment, in place of a
    model's. Enriching keeps every payment as it is, so either form may be given."""
    score = "double(pmod((source_sequence div 100000) * 37 + source_sequence, 1001)) / 1000"
    return with_expr(
        rows,
        label="int(scenario_label <> 'LEGITIMATE')",
        fraud_probability=score,
        ml_prediction=f"int({score} >= 0.5D)",
    )


def payment_scores(spark: SparkSession, d: str) -> DataFrame:
    return with_given_score(payments(spark, d))


def scored_of(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    given = with_given_score(mdl.fill_features(rows)).select(
        *mdl.SCORING_IDS, *mdl.FEATURES, *keep, "fraud_probability", "ml_prediction"
    )
    explained = mdl.explain(mdl.ml_actions(given))
    return mdl.tag_model(explained, "fraud_model", "1", "current").withColumn(
        "scored_at", F.lit("2026-01-01 00:00:00").cast("timestamp")
    )


def _beside(rows: DataFrame) -> DataFrame:
    decided = mdl.with_policy(rows, SETTINGS, also=("source_sequence", "scenario_label"))
    return mdl.set_beside(scored_of(decided, tuple(mdl.POLICY_COLUMNS.values())))


def compared(spark: SparkSession, d: str) -> DataFrame:
    return _beside(enriched(spark, d))


def stored_compared(spark: SparkSession, d: str) -> DataFrame:
    """``compared`` over stored layers."""
    return _beside(stored_enriched(spark, d))


def daily_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation log with one entry per day of events."""
    events = spark.read.parquet(f"{d}/events.parquet")
    share = F.count_if(F.col("event_type") != "view") / F.count(F.lit(1))
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("evaluated_at"),
        F.floor(share * 1000).cast("int").alias("f1_permille"),
    ).select(
        "evaluated_at",
        (F.col("f1_permille") / 1000).alias("f1"),
        ((F.col("f1_permille") + 100) / 1000).alias("roc_auc"),
    )


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed outcomes from events; some lack an analyst or have an unknown outcome."""
    events = raw.with_k(spark.read.parquet(f"{d}/events.parquet"))
    outcome = (
        F.when(F.col("event_type") == "error", "CONFIRMED_FRAUD")
        .when(F.col("event_type") == "view", "FALSE_POSITIVE")
        .when((F.col("event_type") == "click") & (F.col("k") < 5), "LATER")
        .otherwise("NEEDS_MORE_REVIEW")
    )
    text = F.col("event_id").cast("string")
    return events.select(
        F.concat(F.lit("fbk_"), text).alias("feedback_id"),
        F.concat(F.lit("txn_"), text).alias("transaction_id"),
        F.lit("fraud_model").alias("model_name"),
        F.lit("1").alias("model_version"),
        F.when(F.col("k") != 7, F.concat(F.lit("usr_"), F.col("user_id").cast("string"))).alias("analyst_id"),
        outcome.alias("disposition"),
        F.lit(None).cast("string").alias("analyst_notes"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
    )
