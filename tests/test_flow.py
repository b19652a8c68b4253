"""The whole stored flow on the fixture of the published size."""

import pytest

import fixture
from riskweave.plans import medallion as med
from riskweave.settings import Settings
from riskweave.sources import feeds

SETTINGS = Settings(token_namespace="test-namespace")


def _outcome(wh):
    decisions = wh.read("gold_risk_decisions")
    return {r["recommended_action"]: r["count"] for r in decisions.groupBy("recommended_action").count().collect()}


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    wh = med.Warehouse(spark, str(tmp_path_factory.mktemp("batch")), "0001", SETTINGS)
    sent = fixture.all_feeds(spark)
    med.land_feeds(wh, sent, {name: df.count() for name, df in sent.items()})
    med.silver_batch(wh)
    med.run_after_silver(wh, "fraud_model", "1", trees=20)
    return wh


def test_published_decisions(batch):
    assert _outcome(batch) == {"ALLOW": 275, "STEP_UP_AUTH": 342, "REVIEW": 34, "BLOCK": 349}


def test_published_cases(batch):
    queue = batch.read("gold_investigation_queue")
    assert queue.count() == 383
    assert queue.select("case_id").distinct().count() == 383
    assert {r["case_priority"]: r["count"] for r in queue.groupBy("case_priority").count().collect()} == {"P1": 349, "P2": 34}


def test_published_alerts(batch):
    rows = batch.read("gold_access_alerts").orderBy("actor_id").collect()
    assert [(r["actor_id"], r["role_name"], r["access_risk_score"]) for r in rows] == [
        ("usr_00000000", "PLATFORM_ADMIN", 100),
        ("usr_00000001", "ANALYST", 100),
    ]


def test_behaviour_rows(batch):
    scores = [r[0] for r in batch.read("silver_customer_behavioral_features").select("behavioral_risk_score").collect()]
    assert (len(scores), scores.count(100), min(scores)) == (40, 12, 28)


def test_shared_devices(batch):
    network = batch.read("gold_device_network_features")
    linked = {r["device_id"][-3:]: r["linked_customer_count"] for r in network.filter("device_id >= 'dev_00000900'").collect()}
    assert linked == {"900": 2, "901": 2, "950": 3}
    assert [r["device_id"] for r in network.filter("is_shared_device").collect()] == ["dev_00000950"]


def test_nothing_quarantined(batch):
    for name in feeds.FEEDS:
        assert batch.spark.read.parquet(batch.bronze(name)).filter("_status = 'quarantined'").count() == 0


def test_landing_is_reconciled(spark, tmp_path):
    wh = med.Warehouse(spark, str(tmp_path), "0001", SETTINGS)
    sent = fixture.all_feeds(spark)
    expected = {name: df.count() for name, df in sent.items()} | {"access": 1}
    with pytest.raises(ValueError, match="access"):
        med.land_feeds(wh, sent, expected)
    assert not (tmp_path / "bronze_payment").exists()


def test_edges_are_stored_by_kind(batch):
    edges = batch.read("silver_transaction_edges")
    one = edges.where("edge_type = 'USES'")
    assert 0 < len(one.inputFiles()) and one.count() < edges.count()
    assert "PartitionFilters: [isnotnull(edge_type" in one._jdf.queryExecution().executedPlan().toString()


def test_feedback_log_is_started(batch):
    log = batch.spark.read.parquet(batch.path("ml_analyst_feedback"))
    assert log.count() == 0 and "disposition" in log.columns


def test_form_of_silver_is_named(spark):
    with pytest.raises(ValueError, match="silver_from"):
        med.Warehouse(spark, "x", "1", SETTINGS, silver_from="both")


def test_streams_without_landed_rows(spark, tmp_path):
    wh = med.Warehouse(spark, str(tmp_path), "0001", SETTINGS, silver_from="stream")
    med.silver_streams(wh)
    assert wh.read("silver_customers").count() == 0


def test_model_output(batch):
    scored = batch.read("ml_scored_transactions")
    assert scored.count() == 1000
    assert scored.filter("fraud_probability < 0 OR fraud_probability > 1 OR fraud_probability IS NULL").count() == 0
    assert scored.filter("model_policy_action_agreement IS NULL").count() == 0
    log = batch.spark.read.parquet(batch.path("ml_model_evaluation_metrics")).collect()
    assert len(log) == 1 and log[0]["f1"] >= 0.60
    assert log[0]["train_row_count"] + log[0]["test_row_count"] == 1000


def test_view_hides_ids(batch):
    columns = batch.spark.table(med.VIEW).columns
    hidden = {"transaction_id", "customer_id", "account_id", "merchant_id", "device_id", "event_id"}
    assert not hidden & set(columns) and len(columns) == 25
    assert batch.spark.table(med.VIEW).count() == 1000


def test_health_stored(batch):
    rows = batch.read("operational_health_metrics").collect()
    assert sorted(r["control_id"] for r in rows) == [f"OPS-00{i}" for i in range(1, 8)]
    assert not [r for r in rows if r["severity"] == "CRITICAL" and r["control_status"] != "PASS"]


def test_inventory(batch):
    rows = batch.read("governance_control_inventory").orderBy("control_id").collect()
    assert [r["control_id"] for r in rows] == [f"GOV-00{i}" for i in range(1, 6)]


def test_rerun_is_stable(batch):
    before = {r[0] for r in batch.read("gold_risk_decisions").select("decision_id").collect()}
    again = med.Warehouse(batch.spark, batch.root, "0002", SETTINGS)
    med.land_feeds(again, fixture.all_feeds(batch.spark))
    med.silver_batch(again)
    med.features(again)
    med.gold(again)
    assert _outcome(again) == {"ALLOW": 275, "STEP_UP_AUTH": 342, "REVIEW": 34, "BLOCK": 349}
    assert {r[0] for r in again.read("gold_risk_decisions").select("decision_id").collect()} == before


def test_streams_equal_batch(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    landing = {}
    for name, df in fixture.all_feeds(spark).items():
        landing[name] = str(root / f"landing_{name}")
        df.selectExpr(*[f"cast({f.name} AS {f.type}) AS {f.name}" for f in feeds.FEEDS[name].fields]).write.parquet(landing[name])
    wh = med.Warehouse(spark, str(root / "tables"), "0001", SETTINGS, silver_from="stream")
    for step in range(2):  # the second run re-sends every row
        med.land_streams(wh, landing)
        med.silver_streams(wh)
        med.features(wh)
        med.gold(wh)
        assert _outcome(wh) == {"ALLOW": 275, "STEP_UP_AUTH": 342, "REVIEW": 34, "BLOCK": 349}
        assert wh.read("gold_access_alerts").count() == 2
        for name in landing:
            spark.read.parquet(landing[name]).write.mode("append").parquet(landing[name]) if step == 0 else None
    assert wh.accepted("payment").count() == 2000
