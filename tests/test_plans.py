"""What Spark makes of the plans: one shuffle where one is enough, and no hot task."""

import os

import pytest

import fixture
from riskweave.functions.conform import conform
from riskweave.operators import decisions as dec
from riskweave.operators import edges as edg
from riskweave.operators import expectations as exp
from riskweave.operators.latest import dedup_batch
from riskweave.plans import layers as lay
from riskweave.plans import queries
from riskweave.settings import Settings
from riskweave.sources import feeds, sinks

SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")


@pytest.fixture
def conf(spark):
    """Set options for one test."""
    old = {}

    def put(**options):
        for key, value in options.items():
            key = "spark.sql." + key.replace("__", ".")
            old[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df):
    df.collect()
    return _planned(df).split("== Initial Plan ==")[0]


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("string(id % 3) AS k", "id AS seq", "id AS v")
    plan = _planned(dedup_batch(df, "k", ["seq"]))
    assert "Partial" in plan and "Final" in plan and plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange hashpartitioning") == 1


def test_hot_record_id_sends_one_row_per_map_task(spark):
    """A third of all rows are copies of one record."""
    rows = 30000
    df = spark.range(0, rows, 1, 6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id) END AS k", f"{rows} - id AS seq", "id AS v"
    )
    out = dedup_batch(df, "k", ["seq"])
    assert out.filter("k = 'hot'").collect()[0]["v"] == rows - 3
    assert out.count() == 2 * rows // 3 + 1
    grouped = out.groupBy("k").count()
    grouped.collect()

    def written(node):
        found = []
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        for i in range(kids.size()):
            found += written(kids.apply(i))
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            found += written(node.plan())
        return found

    final = grouped._jdf.queryExecution().executedPlan().executedPlan()
    assert max(written(final)) == 2 * rows // 3 + 6  # six map tasks, one row each for the hot key


def test_decisions_scan_payments_once(spark, conf):
    conf(autoBroadcastJoinThreshold="-1")
    plan = _final(lay.decisions(spark, SF))
    assert plan.count("lineitem.parquet") == 1
    assert "ReusedExchange [event_id" in plan


def test_score_and_policy_need_no_join(spark, conf):
    conf(autoBroadcastJoinThreshold="-1")
    plan = _final(lay.compared(spark, SF))
    assert plan.count("lineitem.parquet") == 1
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert joins and not [line for line in joins if "Join [transaction_id" in line or "Join [event_id" in line]


def test_device_network_needs_two_shuffles(spark):
    pay = conform(fixture.payments(spark, 50), feeds.PAYMENT, "p")
    assert _planned(edg.device_network_of(pay)).count("Exchange hashpartitioning") == 2
    assert _planned(edg.device_network(edg.transaction_edges(pay, ("USES",)))).count("Exchange hashpartitioning") == 4


def test_edges_scan_once_and_one_kind_does_not_expand(spark, conf, tmp_path):
    conf(maxMetadataStringLength="2000")
    path = str(tmp_path / "pay")
    conform(fixture.payments(spark, 50), feeds.PAYMENT, "p").write.parquet(path)
    whole = _planned(edg.transaction_edges(spark.read.parquet(path)))
    assert whole.count("FileScan") == 1 and "Generate inline" in whole
    one = _planned(edg.transaction_edges(spark.read.parquet(path), ("USES",)))
    assert "Generate" not in one and "merchant_id" not in one.split("ReadSchema")[1]


def test_rules_reach_the_scan_and_the_other_side_is_pruned(spark, conf, tmp_path):
    conf(maxMetadataStringLength="2000")
    raw, landed = str(tmp_path / "raw"), str(tmp_path / "landed")
    fixture.all_feeds(spark)["access"].write.parquet(raw)
    plan = _planned(exp.accepted(conform(spark.read.parquet(raw), feeds.ACCESS, "a"), feeds.ACCESS.rules).select("actor_id"))
    assert "GreaterThanOrEqual(rows_accessed,0)" in plan and "GreaterThan(source_sequence,0)" in plan
    assert "resource_name" not in plan.split("ReadSchema")[1]
    sinks.land(conform(spark.read.parquet(raw), feeds.ACCESS, "a"), feeds.ACCESS.rules, landed)
    side = _planned(exp.side(spark.read.parquet(landed), exp.ACCEPTED))
    assert "PartitionFilters: [isnotnull(_status" in side


def _skewed(spark, tmp_path):
    """Payments of which a third belong to one customer, with one row per customer aside."""
    pay, people = str(tmp_path / "pay"), str(tmp_path / "people")
    pad = "repeat(sha2(string(id), 256), 6)"
    spark.range(0, 60000, 1, 8).selectExpr(
        "concat('e', id) AS event_id", "timestamp'2026-01-01' AS event_timestamp", "concat('t', id) AS transaction_id",
        "CASE WHEN id % 3 = 0 THEN 'c0' ELSE concat('c', id % 5000) END AS customer_id", "'a' AS account_id",
        f"{pad} AS merchant_id", "concat('d', id % 7000) AS device_id", "CAST(id % 2000 AS decimal(18,2)) AS amount",
        "'CAD' AS currency", "'MOBILE' AS payment_channel", "id AS source_sequence", "'LEGITIMATE' AS scenario_label",
    ).write.parquet(pay)
    spark.range(5000).selectExpr(
        "concat('c', id) AS customer_id", "CASE WHEN id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_segment",
        "'r' AS resolved_identity_id", "id % 90 AS behavioral_risk_score", "array('MFA_BYPASS') AS reason_codes",
        "current_timestamp() AS feature_calculated_at",
    ).write.parquet(people)
    rows, who = spark.read.parquet(pay), spark.read.parquet(people)
    customers = who.select("customer_id", "risk_segment", "resolved_identity_id")
    behavior = who.select("customer_id", "behavioral_risk_score", "reason_codes", "feature_calculated_at")
    enriched = dec.enrich(rows, customers, behavior, edg.device_network_of(rows))
    return dec.decide(enriched, Settings())


def test_hot_customer_is_split_and_the_result_is_the_same(spark, conf, tmp_path):
    conf(autoBroadcastJoinThreshold="-1")
    df = _skewed(spark, tmp_path)
    key = ["decision_id", "risk_score", "linked_customer_count"]
    plain = sorted(df.select(*key).collect())
    conf(
        adaptive__skewJoin__skewedPartitionThresholdInBytes="200k",
        adaptive__advisoryPartitionSizeInBytes="100k",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
    )
    split = df.select(*df.columns)
    plan = _final(split)
    assert "SortMergeJoin(skew=true)" in plan
    assert sorted(split.select(*key).collect()) == plain and len(plain) == 60000


def test_no_query_uses_a_nested_loop_or_python(spark):
    slow = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups")
    eager = {"m9_model_scoring", "t2_stream_auth", "t4_stream_customers", "t4_merged_customers", "s2_backfill", "t1_late_rows"}  # run when called
    for name, query in queries.queries().items():
        if name not in eager:
            plan = _planned(query(spark, SF))
            assert not [s for s in slow if s in plan], name


def test_queries_leave_no_method_too_large_for_the_jvm(spark, conf):
    conf(codegen__hugeMethodLimit="65535")
    out = queries.queries()["j5_m12_compared"](spark, SF)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000" and out.columns


def test_edges_of_all_kinds_move_a_payment_once_before_it_is_expanded(spark):
    pay = conform(fixture.payments(spark, 50), feeds.PAYMENT, "p")
    plan = _planned(edg.transaction_edges(pay))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Exchange hashpartitioning(transaction_id" in plan[plan.index("Generate inline") :]
    assert "Exchange hashpartitioning(kind" in plan[: plan.index("Generate inline")]


def test_shuffles_of_a_session_are_compressed_by_zstd(spark):
    """The option belongs to the start of a session, on executors as well; a running one cannot change it."""
    assert spark.sparkContext.getConf().get("spark.io.compression.codec") == "zstd"
