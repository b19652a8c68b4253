"""Aggregates kept batch by batch, and views that outlive their session."""

import datetime as dt
import itertools
import os

import pytest

from riskweave.operators import decisions as dec
from riskweave.operators import edges as edg
from riskweave.operators import governance as gov
from riskweave.plans import medallion as flow
from riskweave.settings import Settings
from riskweave.sources import rollups, sinks, views

T0 = dt.datetime(2026, 3, 1)
SCHEMA = (
    "transaction_id string, event_timestamp timestamp, amount decimal(18,2), currency string, scenario_label string, "
    "customer_id string, account_id string, merchant_id string, device_id string, risk_score int, risk_level string, "
    "recommended_action string, policy_version string"
)
TIMES = ("network_feature_calculated_at", "metrics_calculated_at")


def _payments(spark, n=240):
    """Ids that come back on other days, null ids, keys and scores, and a time that is not known."""
    rows = [
        (
            None if i % 17 == 0 else f"t{i % 90}",
            None if i == 5 else T0 + dt.timedelta(hours=3 * i),
            f"{i % 13}.{i % 100:02d}",
            ("EUR", "USD", None)[i % 3],
            ("LEGITIMATE", "MULE", None)[i % 5 % 3],
            f"c{i % 11}",
            f"a{i % 7}",
            None if i % 19 == 0 else f"m{i % 3}",
            None if i % 23 == 0 else f"d{i % 4}",
            None if i % 29 == 0 else i % 101,
            ("LOW", "HIGH")[i % 2],
            ("ALLOW", "BLOCK")[i % 2],
            "v1",
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "transaction_id string, event_timestamp timestamp, amount string, " + SCHEMA.split(", ", 3)[3]).selectExpr(
        "transaction_id", "event_timestamp", "cast(amount AS decimal(18,2)) AS amount", *[c.split()[0] for c in SCHEMA.split(", ")[3:]]
    )


def _rows(df):
    return sorted(map(tuple, df.drop(*TIMES).select(*sorted(set(df.columns) - set(TIMES))).collect()), key=repr)


CASES = {
    "edges": (edg.EDGE_ROLLUP, edg.rollup_rows, edg.edges_of_rollup, edg.transaction_edges),
    "devices": (edg.DEVICE_ROLLUP, lambda df: df, edg.network_of_rollup, edg.device_network_of),
    "metrics": (dec.METRICS_ROLLUP, dec.metrics_rows, dec.metrics_of_rollup, dec.decision_metrics),
}
DAY = "coalesce(dayofyear(event_timestamp), 60)"
PARTS = {"first": f"{DAY} < 75", "second": f"{DAY} BETWEEN 75 AND 84", "empty": "false", "third": f"{DAY} > 84"}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("order", [list(PARTS), ["third", "empty", "first", "second"]])
def test_batches_in_any_order_are_one_aggregation(spark, tmp_path, name, order):
    rollup, rows_of, result_of, whole = CASES[name]
    paid, root = _payments(spark), str(tmp_path / "r")
    for batch in order:
        assert rollups.add_batch(rows_of(paid.where(PARTS[batch])), rollup, root, batch)
        assert not rollups.add_batch(rows_of(paid.where(PARTS[batch])), rollup, root, batch)  # sent again
    assert _rows(result_of(rollups.merged(spark, rollup, root))) == _rows(whole(paid))


def test_a_batch_that_broke_off_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    paid, root = _payments(spark), str(tmp_path / "r")
    rollups.add_batch(paid.where(PARTS["first"]), edg.DEVICE_ROLLUP, root, "first")
    write = rollups.append_once

    def breaks(df, path, batch_id, *rest):
        if path.endswith("partials"):
            raise RuntimeError("lost")
        return write(df, path, batch_id, *rest)

    monkeypatch.setattr(rollups, "append_once", breaks)
    with pytest.raises(RuntimeError):
        rollups.add_batch(paid.where(PARTS["second"]), edg.DEVICE_ROLLUP, root, "second")
    monkeypatch.undo()
    # Another batch comes before the broken one is sent again.
    for batch in ("third", "second"):
        assert rollups.add_batch(paid.where(PARTS[batch]), edg.DEVICE_ROLLUP, root, batch)
    got = edg.network_of_rollup(rollups.merged(spark, edg.DEVICE_ROLLUP, root))
    assert _rows(got) == _rows(edg.device_network_of(paid))


def test_a_batch_leaves_the_files_of_others_alone(spark, tmp_path):
    paid, root = _payments(spark), str(tmp_path / "r")

    def files():
        found = itertools.chain.from_iterable([os.path.join(p, f) for f in names] for p, _, names in os.walk(root))
        return {f: os.stat(f).st_mtime_ns for f in found}

    rollups.add_batch(dec.metrics_rows(paid.where(PARTS["first"])), dec.METRICS_ROLLUP, root, "first")
    before = files()
    rollups.add_batch(dec.metrics_rows(paid.where(PARTS["second"])), dec.METRICS_ROLLUP, root, "second")
    after = files()
    assert before.items() <= after.items()
    assert all("batch_id=second" in f for f in after.keys() - before.keys())


def test_stored_values_are_not_shuffled_for_a_small_batch(spark, tmp_path, monkeypatch):
    paid, root, plans = _payments(spark), str(tmp_path / "r"), []
    rollups.add_batch(paid.where(PARTS["first"]), edg.DEVICE_ROLLUP, root, "first")
    write = rollups.append_once

    def looks(df, path, *rest):
        if path.endswith("values_linked_customer_count"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path, *rest)

    monkeypatch.setattr(rollups, "append_once", looks)
    rollups.add_batch(paid.where(PARTS["second"]), edg.DEVICE_ROLLUP, root, "second")
    (plan,) = plans
    semi = plan[plan.index("LeftSemi") :]
    assert "BroadcastHashJoin" in plan[: plan.index("LeftSemi")].splitlines()[-1]
    assert "hashpartitioning" not in plan and semi.count("FileScan") == 2


def test_the_flow_adds_payments_by_batch(spark, tmp_path):
    paid = _payments(spark)
    for version, part in enumerate(PARTS, 1):
        wh = flow.Warehouse(spark, str(tmp_path), str(version), Settings(token_namespace="n"))
        flow.add_payments(wh, part, paid.where(PARTS[part]))
    assert _rows(wh.read("silver_transaction_edges")) == _rows(edg.transaction_edges(paid))
    assert _rows(wh.read("gold_device_network_features")) == _rows(edg.device_network_of(paid))


def test_a_rollup_without_batches_says_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        rollups.merged(spark, edg.DEVICE_ROLLUP, str(tmp_path / "none"))


def _scored(spark, n):
    names = [source for _, _, source in gov.TOKENS] + [c for c in gov.OPEN_COLUMNS]
    return spark.range(n).selectExpr(*[f"concat('{c}-', id) AS {c}" for c in dict.fromkeys(names)])


def test_a_view_opens_again_in_another_session(spark, tmp_path):
    table, root = str(tmp_path / "scored"), str(tmp_path / "views")
    sinks.write_version(_scored(spark, 3), table, "1")
    views.save_view(spark, root, "secure", table)
    views.save_view(spark, root, "secure", table)  # the same definition is not written again
    other = spark.newSession()
    assert not other.catalog.tableExists("secure")
    assert views.open_views(other, root, "secret-namespace") == ["secure"]
    assert _rows(other.table("secure")) == _rows(gov.protected(_scored(spark, 3), "secret-namespace"))
    sinks.write_version(_scored(spark, 5), table, "2")
    assert views.open_view(other, root, "secure", "secret-namespace").count() == 5
    stored = [os.path.join(p, f) for p, _, names in os.walk(root) for f in names]
    assert len([f for f in stored if not f.endswith(".crc")]) == 1
    assert all(b"secret-namespace" not in open(f, "rb").read() for f in stored)


def test_a_view_needs_a_namespace_and_a_definition(spark, tmp_path):
    table, root = str(tmp_path / "scored"), str(tmp_path / "views")
    sinks.write_version(_scored(spark, 1), table, "1")
    views.save_view(spark, root, "secure", table)
    with pytest.raises(ValueError):
        views.open_view(spark, root, "secure", "")
    with pytest.raises(FileNotFoundError):
        views.open_view(spark, root, "other", "n")


@pytest.mark.parametrize("name", CASES)
def test_large_batches_are_compared_by_hash_first(spark, tmp_path, monkeypatch, name):
    """Values that come again, in batches that Spark does not broadcast: only they leave the stored files."""
    rollup, rows_of, result_of, whole = CASES[name]
    paid, root, moved = _payments(spark), str(tmp_path / "r"), {}
    monkeypatch.setattr(rollups, "_broadcasts", lambda df: False)
    keep = rollups._stored

    def looks(df, path):
        moved[os.path.basename(path)] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, path)

    monkeypatch.setattr(rollups, "_stored", looks)
    for batch in ("first", "second", "empty", "third"):
        assert rollups.add_batch(rows_of(paid.where(PARTS[batch])), rollup, root, batch)
        assert not [p for p, _, _ in os.walk(root) if "/_again" in p or "/_seen" in p or "/_shown" in p]
    assert _rows(result_of(rollups.merged(spark, rollup, root))) == _rows(whole(paid))
    assert "hashpartitioning" not in moved["_seen-second"] and "BroadcastHashJoin [_hash" in moved["_seen-second"]


def test_rows_and_new_values_are_folded_in_one_grouping(spark, tmp_path, monkeypatch):
    paid, plans, write = _payments(spark), [], rollups.append_once

    def looks(df, path, *rest):
        if path.endswith("partials"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path, *rest)

    monkeypatch.setattr(rollups, "append_once", looks)
    rollups.add_batch(paid.where(PARTS["first"]), edg.DEVICE_ROLLUP, str(tmp_path / "r"), "first")
    (plan,) = plans
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
