"""The whole flow with every layer stored: Bronze, Silver, Gold, model, view, health.

Each step reads stored tables and writes one. That ends a plan's lineage at the
shared folder, so a lost executor costs the tasks of one step, and a step can be run
again by itself: a full refresh goes to a folder named by the run's version.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskweave.functions.conform import conform
from riskweave.operators import access as acc
from riskweave.operators import behavior as beh
from riskweave.operators import decisions as dec
from riskweave.operators import edges as edg
from riskweave.operators import governance as gov
from riskweave.operators import health as hea
from riskweave.operators import model as mdl
from riskweave.operators.evaluation import evaluate, evaluation_record
from riskweave.operators.expectations import check_columns, require
from riskweave.operators.identity import resolve_identity
from riskweave.operators.latest import CUSTOMER_SEQUENCE, current_customers, dedup_batch
from riskweave.operators.payments import PAYMENT_ORDER, payment_dates
from riskweave.operators.reconcile import check_landing
from riskweave.settings import Settings
from riskweave.sources import feeds, views
from riskweave.sources.rollups import add_batch, merged
from riskweave.sources.readers import accepted_stream, accepted_table, stream
from riskweave.sources.sinks import append, land, read_version, start_feedback, write_version
from riskweave.streaming.cdc import compact_changes, fold_changes, folded_state
from riskweave.streaming.dedup import dedup_stream
from riskweave.streaming.ingest import land_stream, run_available, run_batches

VIEW = "secure_investigator_transactions"
_FLAGS = {
    "authentication": (beh.auth_flags, feeds.AUTHENTICATION_GUARD, beh.AUTH_ORDER),
    "device_intelligence": (beh.device_flags, feeds.DEVICE_GUARD, beh.OBSERVATION_ORDER),
    "access": (acc.access_flags, feeds.ACCESS_GUARD, acc.ACCESS_ORDER),
}


@dataclass(frozen=True)
class Warehouse:
    """Where the tables of one run are. ``silver_from`` says which of the two forms of Silver
    events the later steps read: ``batch`` (recomputed) or ``stream`` (continued)."""

    spark: SparkSession
    root: str
    version: str
    settings: Settings
    silver_from: str = "batch"

    def __post_init__(self) -> None:
        if self.silver_from not in ("batch", "stream"):
            raise ValueError(f"silver_from is batch or stream, not {self.silver_from!r}")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def bronze(self, feed: str) -> str:
        return self.path(f"bronze_{feed}")

    def accepted(self, feed: str) -> DataFrame:
        return accepted_table(self.spark, self.bronze(feed))

    def accepted_rows(self, feed: str) -> DataFrame:
        """An accepted feed of which nothing has landed yet: no rows, its columns."""
        stamps = "_source_table string, _ingested_at timestamp"
        fields = feeds.FEEDS[feed].schema.fields + T.StructType.fromDDL(stamps).fields
        return self.spark.createDataFrame([], T.StructType(fields))

    def read(self, table: str) -> DataFrame:
        return read_version(self.spark, self.path(table))

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        write_version(df, self.path(table), self.version, partition_by)


def land_feeds(
    wh: Warehouse, raw: Mapping[str, DataFrame], expected: Mapping[str, int] | None = None
) -> None:
    """Bronze from batch frames: one read and one write per feed. With ``expected``, the rows
    that each feed was sent with, the batch is reconciled first and nothing lands if it is not
    what was sent."""
    if expected is not None:
        check_landing(raw["payment"], {n: df for n, df in raw.items() if n != "payment"}, expected)
    for name, df in raw.items():
        feed = feeds.FEEDS[name]
        land(conform(check_columns(df, feed), feed, name), feed.rules, wh.bronze(name))


def silver_batch(wh: Warehouse) -> None:
    """Silver events and customers, recomputed from all landed rows."""
    paid = dedup_batch(wh.accepted("payment"), "event_id", PAYMENT_ORDER)
    wh.write("silver_payments", payment_dates(require(paid, feeds.PAYMENT_GUARD)), "event_date")
    for name, (flags, guard, order) in _FLAGS.items():
        once = dedup_batch(wh.accepted(name), feeds.FEEDS[name].key, order)
        wh.write(f"silver_{name}", flags(require(once, guard)))
    current = current_customers(wh.accepted("customer_change"))
    wh.write("silver_customers", require(resolve_identity(current), feeds.CUSTOMER_GUARD))


def land_streams(wh: Warehouse, landing: Mapping[str, str]) -> None:
    """Bronze from landing folders: what is new since the last run."""
    for name, folder in landing.items():
        feed = feeds.FEEDS[name]
        raw = stream(wh.spark, folder, feed.schema)
        land_stream(raw, feed, name, wh.bronze(name), wh.path(f"_log/bronze_{name}"))


def _accepted_stream(wh: Warehouse, name: str) -> DataFrame:
    return accepted_stream(wh.spark, wh.bronze(name), feeds.FEEDS[name])


def silver_streams(wh: Warehouse) -> None:
    """Silver events and customers, continued from the last run's checkpoints."""
    how = {"delay": wh.settings.watermark, "splits": wh.settings.stream_splits}
    paid = dedup_stream(_accepted_stream(wh, "payment"), "event_id", "event_timestamp", **how)
    run_available(
        payment_dates(require(paid, feeds.PAYMENT_GUARD)),
        wh.path("silver_payments/version=stream"),
        wh.path("_log/silver_payments"),
        ["event_date"],
    )
    for name, (flags, guard, _) in _FLAGS.items():
        feed = feeds.FEEDS[name]
        once = dedup_stream(_accepted_stream(wh, name), feed.key, feed.event_time, **how)
        run_available(
            flags(require(once, guard)),
            wh.path(f"silver_{name}/version=stream"),
            wh.path(f"_log/silver_{name}"),
        )
    changes, key = wh.path("bronze_customer_newest"), ["customer_id"]
    run_batches(
        _accepted_stream(wh, "customer_change"),
        fold_changes(changes, key, CUSTOMER_SEQUENCE),
        wh.path("_log/bronze_customer_newest"),
    )
    # Folded into one table, so that the next run reads the newest changes and what came since.
    if compact_changes(wh.spark, changes, key, CUSTOMER_SEQUENCE):
        current = folded_state(
            wh.spark, changes, key, CUSTOMER_SEQUENCE, "operation = 'DELETE'", ["operation", "change_id"]
        )
    else:
        current = wh.accepted_rows("customer_change").drop("operation", "change_id")
    wh.write("silver_customers", require(resolve_identity(current), feeds.CUSTOMER_GUARD))


def _silver(wh: Warehouse, name: str) -> DataFrame:
    """A Silver event table in the form that the run's settings name."""
    if wh.silver_from == "stream":
        return wh.spark.read.parquet(wh.path(f"silver_{name}/version=stream"))
    return wh.read(f"silver_{name}")


def features(wh: Warehouse) -> None:
    """Edges, behaviour, access signals, the device network, and payments with all of it."""
    # By kind, so that a reader of one kind opens the files of that kind alone.
    wh.write("silver_transaction_edges", edg.transaction_edges(_silver(wh, "payments")), "edge_type")
    behavior = beh.behavioral_features(_silver(wh, "authentication"), _silver(wh, "device_intelligence"))
    wh.write("silver_customer_behavioral_features", behavior)
    wh.write("silver_access_risk_signals", acc.access_signals(_silver(wh, "access")))
    wh.write("gold_device_network_features", edg.device_network(wh.read("silver_transaction_edges")))
    joined = dec.enrich(
        _silver(wh, "payments"),
        wh.read("silver_customers"),
        wh.read("silver_customer_behavioral_features"),
        wh.read("gold_device_network_features"),
    )
    wh.write("enriched_payments", joined)


def add_payments(wh: Warehouse, batch_id: str, paid: DataFrame) -> None:
    """Edges and device sharing of all batches so far, from a batch of deduplicated payments that no
    other batch holds (a day, or what came late for one): only its own rows are aggregated."""
    add_batch(edg.rollup_rows(paid), edg.EDGE_ROLLUP, wh.path("silver_edge_rollup"), batch_id)
    add_batch(paid, edg.DEVICE_ROLLUP, wh.path("gold_device_rollup"), batch_id)
    edges = merged(wh.spark, edg.EDGE_ROLLUP, wh.path("silver_edge_rollup"))
    wh.write("silver_transaction_edges", edg.edges_of_rollup(edges), "edge_type")
    devices = merged(wh.spark, edg.DEVICE_ROLLUP, wh.path("gold_device_rollup"))
    wh.write("gold_device_network_features", edg.network_of_rollup(devices))


def enriched(wh: Warehouse) -> DataFrame:
    """Payments with their features, joined once for decisions, training and scoring."""
    return wh.read("enriched_payments")


def gold(wh: Warehouse) -> None:
    """Decisions and what follows from them."""
    wh.write("gold_risk_decisions", dec.decide(enriched(wh), wh.settings))
    decisions = wh.read("gold_risk_decisions")
    wh.write("gold_investigation_queue", dec.investigation_queue(decisions))
    wh.write("gold_decision_metrics", dec.decision_metrics(decisions))
    wh.write(
        "gold_access_alerts", acc.access_alerts(wh.read("silver_access_risk_signals"), wh.settings)
    )


def train(wh: Warehouse, model_name: str, model_version: str, trees: int = 200) -> str:
    """Fit, store, evaluate on the test part, and append the result to the log."""
    wh.write("ml_training_frame", mdl.training_frame(enriched(wh)))
    frame = wh.read("ml_training_frame")
    counts = mdl.check_classes(frame)
    train_rows, test_rows = mdl.split(frame)
    model = mdl.fit(train_rows, trees=trees)
    model_path = wh.path(f"ml_models/{model_name}/{model_version}")
    model.write().overwrite().save(model_path)
    wh.write("ml_test_scores", mdl.predict(model, test_rows).select("label", "fraud_probability"))
    entry = evaluation_record(
        wh.spark,
        evaluate(wh.read("ml_test_scores")),
        counts["train"],
        model_name=model_name,
        model_version=model_version,
        run_id=wh.version,
        model_uri=model_path,
        evaluated_at=datetime.now(timezone.utc),
    )
    append(entry, wh.path("ml_model_evaluation_metrics"))
    return model_path


def score(wh: Warehouse, model_path: str, tags: Mapping[str, str]) -> None:
    """Score all payments beside the policy's decision of the same row, and start the log of
    analyst feedback that the output is reviewed in."""
    mdl.check_rows(_silver(wh, "payments"))
    model = mdl.PipelineModel.load(model_path)
    output = mdl.score_beside_policy(model, enriched(wh), tags, wh.settings)
    wh.write("ml_scored_transactions", output)
    start_feedback(wh.spark, wh.path("ml_analyst_feedback"))
    wh.write("ml_scoring_metrics", mdl.scoring_metrics(wh.read("ml_scored_transactions")))


def govern(wh: Warehouse, model_name: str) -> DataFrame:
    """The protected view, whose definition is stored so that a later session can open it, and the
    control inventory."""
    views.save_view(wh.spark, wh.path("_views"), VIEW, wh.path("ml_scored_transactions"))
    view = views.open_view(wh.spark, wh.path("_views"), VIEW, wh.settings.token_namespace)
    wh.write(
        "governance_control_inventory",
        gov.control_inventory(wh.spark, wh.root, VIEW, model_name, wh.path("ml_analyst_feedback")),
    )
    return view


def check(wh: Warehouse, view: DataFrame, environment: str = "dev") -> None:
    """Store all health results, then raise when a critical one failed."""
    sides = {name: wh.spark.read.parquet(wh.bronze(name)) for name in feeds.FEEDS}
    evaluations = wh.spark.read.parquet(wh.path("ml_model_evaluation_metrics"))
    rows = hea.health(
        wh.read("ml_scored_transactions"), evaluations, hea.status_counts(sides), view,
        environment=environment,
    )
    wh.write("operational_health_metrics", rows)
    hea.enforce(wh.read("operational_health_metrics"))


def run_after_silver(wh: Warehouse, model_name: str, model_version: str, trees: int = 200) -> None:
    features(wh)
    gold(wh)
    path = train(wh, model_name, model_version, trees)
    score(wh, path, {"name": model_name, "version": model_version, "alias": "current"})
    check(wh, govern(wh, model_name))
