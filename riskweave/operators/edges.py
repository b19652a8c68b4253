"""Relationship edges between parties of a payment, and device sharing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import with_expr
from riskweave.settings import LEGITIMATE, SHARED_DEVICE_CUSTOMERS
from riskweave.sources.rollups import Rollup

# --- Fixed values: edge kind -> source type, source column, target type, target column
EDGE_KINDS = {
    "OWNS": ("CUSTOMER", "customer_id", "ACCOUNT", "account_id"),
    "PAYS": ("ACCOUNT", "account_id", "MERCHANT", "merchant_id"),
    "USES": ("CUSTOMER", "customer_id", "DEVICE", "device_id"),
}
# --- End of fixed values -----------------------------------------------------------

# The measures of an edge and of a device, kept up to date batch by batch (see sources/rollups.py).
EDGE_ROLLUP = Rollup(
    keys=("kind", "source_id", "target_id", "currency"),
    sums={"total_amount": "amount", "labeled_risk_event_count": f"if(scenario_label <> '{LEGITIMATE}', 1, 0)"},
    lows={"first_seen_at": "event_timestamp"},
    highs={"last_seen_at": "event_timestamp"},
    distinct={"transaction_count": "transaction_id"},
)
DEVICE_ROLLUP = Rollup(
    keys=("device_id",),
    sums={"network_total_amount": "amount"},
    highs={"network_last_seen_at": "event_timestamp"},
    distinct={
        "linked_customer_count": "customer_id",
        "network_transaction_count": "CASE WHEN transaction_id IS NOT NULL THEN struct(customer_id, currency, transaction_id) END",
    },
)

_CARRIED = ("transaction_id", "event_timestamp", "amount", "currency", "scenario_label")


def _ends(payments: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per payment and edge kind, the kind as its number in ``kinds``.

    Several kinds come from one scan by expanding an array. One kind is a plain
    projection, which neither expands rows nor reads the other kinds' columns.
    """
    ends = []
    for number, kind in enumerate(kinds):
        _, source, _, target = EDGE_KINDS[kind]
        ends.append([f"{number}Y AS kind", f"{source} AS source_id", f"{target} AS target_id"])
    if len(ends) == 1:
        return payments.selectExpr(*ends[0], *_CARRIED)
    structs = ", ".join(f"struct({', '.join(e)})" for e in ends)
    return payments.selectExpr(f"inline(array({structs}))", *_CARRIED)


def _named(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Replace the kind's number by its three names."""

    def name(pick) -> str:
        cases = " ".join(f"WHEN {n} THEN '{pick(kind)}'" for n, kind in enumerate(kinds))
        return f"CASE kind {cases} END"

    rest = [c for c in rows.columns if c not in ("kind", "source_id", "target_id")]
    return rows.selectExpr(
        f"{name(lambda k: k)} AS edge_type",
        f"{name(lambda k: EDGE_KINDS[k][0])} AS source_type",
        "source_id",
        f"{name(lambda k: EDGE_KINDS[k][2])} AS target_type",
        "target_id",
        *rest,
    )


def edge_rows(payments: DataFrame, kinds: Iterable[str] = tuple(EDGE_KINDS)) -> DataFrame:
    """One named row per payment and edge kind."""
    kinds = tuple(kinds)
    return _named(_ends(payments, kinds), kinds)


def transaction_edges(payments: DataFrame, kinds: Iterable[str] = tuple(EDGE_KINDS)) -> DataFrame:
    """Edges per pair and currency.

    Rows are shuffled with the kind's number and get its names afterwards. Spark spreads
    the distinct count by edge and transaction first, so a busy edge is not counted in
    one task. For several kinds payments are dealt by transaction before a payment becomes
    a row per kind: that puts the rows of an edge and transaction together as well, and
    moves one row per payment.
    """
    kinds = tuple(kinds)
    if len(kinds) > 1:
        parties = [c for kind in kinds for c in EDGE_KINDS[kind][1::2]]
        payments = payments.select(*dict.fromkeys(parties), *_CARRIED).repartition("transaction_id")
    edges = _ends(payments, kinds).groupBy("kind", "source_id", "target_id", "currency").agg(
        F.expr("count(DISTINCT transaction_id) AS transaction_count"),
        F.expr("round(sum(amount), 2) AS total_amount"),
        F.expr("min(event_timestamp) AS first_seen_at"),
        F.expr("max(event_timestamp) AS last_seen_at"),
        F.expr(f"count_if(scenario_label <> '{LEGITIMATE}') AS labeled_risk_event_count"),
    )
    return _named(edges, kinds)


def rollup_rows(payments: DataFrame, kinds: Sequence[str] = tuple(EDGE_KINDS)) -> DataFrame:
    """Rows that a batch adds to ``EDGE_ROLLUP``."""
    return _ends(payments, kinds)


def edges_of_rollup(merged: DataFrame, kinds: Sequence[str] = tuple(EDGE_KINDS)) -> DataFrame:
    """``transaction_edges`` from the merged rollup of all batches."""
    rows = merged.selectExpr(
        "kind", "source_id", "target_id", "currency", "transaction_count", "round(total_amount, 2) AS total_amount",
        "first_seen_at", "last_seen_at", "labeled_risk_event_count",
    )
    return _named(rows, kinds)


def network_of_rollup(merged: DataFrame) -> DataFrame:
    """``device_network_of`` from the merged rollup of all batches."""
    rows = merged.selectExpr(
        "device_id", "linked_customer_count", "network_transaction_count",
        "round(network_total_amount, 2) AS network_total_amount", "network_last_seen_at",
    )
    return _shared(rows)


def device_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("edge_type = 'USES' AND target_type = 'DEVICE'")


def _shared(network: DataFrame) -> DataFrame:
    return with_expr(
        network,
        is_shared_device=f"linked_customer_count >= {SHARED_DEVICE_CUSTOMERS}",
        network_feature_calculated_at="current_timestamp()",
    )


def device_network(edges: DataFrame) -> DataFrame:
    """Sharing features per device from the stored edge table."""
    return _shared(
        device_edges(edges)
        .groupBy(F.col("target_id").alias("device_id"))
        .agg(
            F.expr("count(DISTINCT source_id) AS linked_customer_count"),
            F.expr("sum(transaction_count) AS network_transaction_count"),
            F.expr("round(sum(total_amount), 2) AS network_total_amount"),
            F.expr("max(last_seen_at) AS network_last_seen_at"),
        )
    )


def device_network_of(payments: DataFrame) -> DataFrame:
    """The same features straight from payments, when no edge table is stored.

    Summing an edge's distinct transactions over a device's edges equals counting the
    distinct (customer, currency, transaction) of the device. That is one aggregation
    with two shuffles, where building the edges first and then folding them takes four.
    """
    per_edge = "CASE WHEN transaction_id IS NOT NULL THEN struct(customer_id, currency, transaction_id) END"
    return _shared(
        payments.groupBy("device_id").agg(
            F.expr("count(DISTINCT customer_id) AS linked_customer_count"),
            F.expr(f"count(DISTINCT {per_edge}) AS network_transaction_count"),
            F.expr("round(sum(amount), 2) AS network_total_amount"),
            F.expr("max(event_timestamp) AS network_last_seen_at"),
        )
    )
