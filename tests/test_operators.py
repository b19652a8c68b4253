"""Row-level behaviour of single operators on hand-written rows."""

import datetime as dt
import json

import pytest

import fixture
from riskweave.functions.conform import MALFORMED, conform
from riskweave.operators import access as acc
from riskweave.operators import behavior as beh
from riskweave.operators import decisions as dec
from riskweave.operators import edges as edg
from riskweave.operators import expectations as exp
from riskweave.operators import governance as gov
from riskweave.operators import health as hea
from riskweave.operators import model as mdl
from riskweave.operators import reconcile as rec
from riskweave.operators.identity import resolve_identity
from riskweave.operators.latest import current_customers, dedup_batch
from riskweave.settings import Settings
from riskweave.sources import feeds, sinks
from pyspark.sql import functions as F

PAY = feeds.PAYMENT


def _payments(spark, **changes):
    """One valid text payment per entry of the longest change, with changed columns."""
    base = {
        "event_id": "e", "event_timestamp": "2026-01-01T00:00:00Z", "transaction_id": "t", "customer_id": "c",
        "account_id": "a", "merchant_id": "m", "device_id": "d", "ip_address": "10.0.0.1", "amount": "10.00",
        "currency": "CAD", "payment_channel": "ECOMMERCE", "event_type": "CAPTURE", "source_sequence": "1",
        "is_synthetic": "true", "scenario_label": "LEGITIMATE",
    }
    n = max((len(v) for v in changes.values()), default=1)
    rows = []
    for i in range(n):
        row = {**base, "event_id": f"e{i}", "transaction_id": f"t{i}"}
        row.update({k: v[i] for k, v in changes.items()})
        rows.append(tuple(row[c] for c in PAY.columns))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PAY.columns))


def _reasons(df):
    return {r["event_id"]: r[exp.REASONS] for r in df.collect()}


def test_null_counts_as_broken_and_every_rule_is_named(spark):
    raw = _payments(
        spark,
        amount=["10.00", None, "-1", "5", "x"],
        source_sequence=["1", "1", None, "1", "1"],
        currency=["CAD", "CAD", "CAD", "JPY", "USD"],
        event_timestamp=["2026-01-01T00:00:00Z"] * 4 + ["not a time"],
    )
    staged = conform(raw, PAY, "payment")
    held = exp.quarantined(staged, PAY.rules)
    assert _reasons(held) == {
        "e1": "payment_amount_positive",
        "e2": "payment_amount_positive,payment_sequence_positive",
        "e3": "payment_currency_supported",
        "e4": "payment_timestamp_required,payment_amount_positive,event_timestamp_malformed,amount_malformed",
    }
    kept = exp.accepted(staged, PAY.rules)
    assert [r["event_id"] for r in kept.collect()] == ["e0"]
    assert kept.count() + held.count() == raw.count()
    counts = {r["rule_name"]: r["violation_count"] for r in exp.violation_counts(staged, PAY.rules).collect()}
    assert counts["payment_amount_positive"] == 3 and counts["payment_sequence_positive"] == 1


def test_malformed_column_without_a_rule_is_quarantined(spark):
    raw = fixture.devices(spark, 3).withColumn("is_vpn", F.expr("CASE WHEN source_sequence = 2 THEN 'perhaps' ELSE 'true' END"))
    staged = conform(raw, feeds.DEVICE, "device")
    held = exp.quarantined(staged, feeds.DEVICE.rules).collect()
    assert [r[exp.REASONS] for r in held] == ["is_vpn_malformed"]
    assert exp.accepted(staged, feeds.DEVICE.rules).count() == 2


def test_tagged_holds_both_sides(spark, tmp_path):
    staged = conform(_payments(spark, amount=["1", "-1", "2"]), PAY, "payment")
    sinks.land(staged, PAY.rules, str(tmp_path / "t"))
    landed = spark.read.parquet(str(tmp_path / "t"))
    assert exp.side(landed, exp.ACCEPTED).columns == exp.accepted(staged, PAY.rules).columns
    assert exp.side(landed, exp.QUARANTINED).columns == exp.quarantined(staged, PAY.rules).columns
    assert landed.groupBy(exp.STATUS).count().orderBy(exp.STATUS).collect() == [("accepted", 2), ("quarantined", 1)]


def test_conform_types_and_case(spark):
    staged = conform(fixture.authentication(spark, 5).withColumn("country", F.lower("country")), feeds.AUTHENTICATION, "auth")
    assert {f.name: f.dataType.simpleString() for f in staged.schema if not f.name.startswith("_")} == {
        f.name: f.type for f in feeds.AUTHENTICATION.fields
    }
    assert {r["country"] for r in staged.collect()} == {"CA"}
    assert conform(_payments(spark), PAY, "p").schema["amount"].dataType.simpleString() == "decimal(18,2)"


@pytest.mark.parametrize("name", list(feeds.FEEDS))
def test_contracts_accept_the_fixture(spark, name):
    df, feed = fixture.all_feeds(spark)[name], feeds.FEEDS[name]
    exp.check_columns(df, feed)
    staged = conform(df, feed, name)
    assert exp.quarantined(staged, exp.contract_rules(feed)).count() == 0


def test_contract_limits(spark):
    raw = _payments(
        spark,
        amount=["0", "0.01", "1", "1", "1"],
        payment_channel=["MOBILE", "PIGEON", "MOBILE", "MOBILE", "MOBILE"],
        device_id=["d", "d", "", None, "d"],
        is_synthetic=["true", "true", "true", "true", "false"],
    )
    held = exp.quarantined(conform(raw, PAY, "p"), exp.contract_rules(PAY))
    assert _reasons(held) == {
        "e0": "amount_above", "e1": "payment_channel_allowed", "e2": "device_id_min_length",
        "e3": "device_id_required", "e4": "is_synthetic_constant",
    }


def test_contract_nullable_and_length(spark):
    rows = [("2026-01-01", None, None), ("2026-01-02", "CAN", "NONE")]
    df = spark.createDataFrame(rows, "t string, country string, risk_segment string").selectExpr(
        "t AS change_id", "t AS change_timestamp", "'INSERT' AS operation", "'c' AS customer_id", "risk_segment",
        "country", "CAST(NULL AS string) AS email_hash", "CAST(NULL AS string) AS phone_hash",
        "1L AS source_sequence", "true AS is_synthetic",
    )
    feed = feeds.CUSTOMER_CHANGE
    held = exp.quarantined(conform(df, feed, "c"), exp.contract_rules(feed)).collect()
    assert [r[exp.REASONS] for r in held] == ["risk_segment_allowed,country_max_length"]


def test_closed_columns(spark):
    with pytest.raises(ValueError, match="unexpected columns"):
        exp.check_columns(_payments(spark).withColumn("more", F.lit(1)), PAY)
    with pytest.raises(ValueError, match="missing columns"):
        exp.check_columns(_payments(spark).drop("amount"), PAY)


def test_require_stops_the_job(spark):
    good = conform(_payments(spark), PAY, "p")
    assert exp.require(good, feeds.PAYMENT_GUARD).count() == 1
    bad = conform(_payments(spark, account_id=["a", None]), PAY, "p")
    with pytest.raises(Exception, match="payment_parties_complete"):
        exp.require(bad, feeds.PAYMENT_GUARD).collect()


def test_dedup_keeps_the_lowest(spark):
    rows = [("a", 3, 1), ("a", 2, 9), ("a", 2, 5), ("b", None, 1), ("b", 7, 2)]
    df = spark.createDataFrame(rows, "id string, seq int, v int")
    assert sorted(map(tuple, dedup_batch(df, "id", ["seq", "v"]).collect())) == [("a", 2, 5), ("b", 7, 2)]


def _change(i, op, seq, segment="LOW", email="e", phone="p", minute=0):
    return (f"chg{i:03d}", dt.datetime(2026, 1, 1, 0, minute), op, "c1", segment, "ca ", email, phone, seq, True)


def _changes(spark, rows):
    return spark.createDataFrame(rows, feeds.CUSTOMER_CHANGE.schema)


def test_current_state(spark):
    newest_wins = _changes(spark, [_change(1, "INSERT", 1), _change(2, "UPDATE", 3, None), _change(3, "UPDATE", 2, "HIGH")])
    row = current_customers(newest_wins).collect()[0]
    assert row["risk_segment"] is None and "operation" not in row.asDict() and "change_id" not in row.asDict()
    deleted = _changes(spark, [_change(1, "INSERT", 1), _change(2, "DELETE", 3), _change(3, "UPDATE", 2)])
    assert current_customers(deleted).count() == 0
    back = _changes(spark, [_change(1, "DELETE", 1), _change(2, "INSERT", 2)])
    assert current_customers(back).count() == 1
    tie = _changes(spark, [_change(1, "UPDATE", 5, "LOW"), _change(2, "UPDATE", 5, "HIGH")])
    assert current_customers(tie).collect()[0]["risk_segment"] == "HIGH"


def test_identity(spark):
    df = _changes(spark, [_change(1, "INSERT", 1, " high "), _change(2, "INSERT", 1, None, None, None), _change(3, "INSERT", 1, "LOW", None, None), _change(4, "INSERT", 1, "LOW", "e", None)])
    rows = {r["change_id"]: r for r in resolve_identity(df).collect()}
    assert rows["chg001"]["risk_segment"] == "HIGH" and rows["chg001"]["country"] == "CA"
    assert [rows[f"chg00{i}"]["identity_match_method"] for i in (1, 2, 4)] == ["EMAIL_AND_PHONE_HASH", "PARTIAL_HASH_IDENTITY", "PARTIAL_HASH_IDENTITY"]
    assert rows["chg002"]["resolved_identity_id"] == rows["chg003"]["resolved_identity_id"]
    assert len({r["resolved_identity_id"] for r in rows.values()}) == 3


def _typed_payments(spark, **changes):
    return conform(_payments(spark, **changes), PAY, "p").drop(MALFORMED)


def test_edges_and_network(spark):
    pay = _typed_payments(
        spark,
        customer_id=["c1", "c1", "c2", "c3", "c1"],
        device_id=["d1", "d1", "d1", "d1", None],
        transaction_id=["t1", "t1", "t2", "t3", "t4"],
        currency=["CAD", "USD", "CAD", "CAD", "CAD"],
        scenario_label=["LEGITIMATE", "LAYERING", "LEGITIMATE", "LEGITIMATE", None],
    )
    edges = edg.transaction_edges(pay)
    assert edges.filter("edge_type = 'OWNS'").agg(F.sum("total_amount")).first()[0] == 50
    assert edges.agg(F.sum("labeled_risk_event_count")).first()[0] == 3
    from_edges = edg.device_network(edges).drop("network_feature_calculated_at")
    direct = edg.device_network_of(pay).drop("network_feature_calculated_at")
    key = lambda r: str(r)
    assert sorted(from_edges.collect(), key=key) == sorted(direct.collect(), key=key)
    shared = {r["device_id"]: (r["linked_customer_count"], r["network_transaction_count"], r["is_shared_device"]) for r in direct.collect()}
    assert shared == {"d1": (3, 4, True), None: (1, 1, False)}
    two = edg.device_network_of(pay.filter("customer_id <> 'c3'")).filter("device_id = 'd1'").first()
    assert (two["linked_customer_count"], two["is_shared_device"]) == (2, False)


def test_one_kind_equals_its_part_of_all(spark):
    pay = conform(fixture.payments(spark, 200), PAY, "p")
    whole = edg.device_edges(edg.transaction_edges(pay))
    assert sorted(whole.collect()) == sorted(edg.transaction_edges(pay, ("USES",)).collect())


def _enriched(spark, rows):
    columns = (
        "event_id string, transaction_id string, event_timestamp timestamp, customer_id string, account_id string, "
        "merchant_id string, device_id string, amount decimal(18,2), currency string, payment_channel string, "
        "behavioral_risk_score bigint, reason_codes array<string>, linked_customer_count bigint, "
        "network_transaction_count bigint, network_total_amount decimal(28,2), is_shared_device boolean, "
        "risk_segment string, resolved_identity_id string"
    )
    from decimal import Decimal

    full = [
        (f"e{i}", f"t{i}", dt.datetime(2026, 1, 1), "c", "a", "m", "d", Decimal(a), "CAD", channel, score, codes, None, None, None, shared, segment, None)
        for i, (a, channel, score, codes, shared, segment) in enumerate(rows)
    ]
    return spark.createDataFrame(full, columns)


def _decided(spark, rows):
    return dec.decide(_enriched(spark, rows), Settings()).orderBy("event_id").collect()


def test_amount_boundaries(spark):
    rows = [(a, "TRANSFER", 0, None, None, None) for a in ("749.99", "750.00", "1499.99", "1500.00")]
    out = _decided(spark, rows)
    assert [r["risk_score"] for r in out] == [0, 10, 10, 25]
    assert [r["reason_codes"] for r in out] == [[], ["ELEVATED_VALUE_PAYMENT"], ["ELEVATED_VALUE_PAYMENT"], ["HIGH_VALUE_PAYMENT"]]


def test_score_boundaries(spark):
    rows = [("1.00", "TRANSFER", s, None, False, "LOW") for s in (34, 35, 59, 60, 79, 80)]
    out = _decided(spark, rows)
    assert [r["risk_level"] for r in out] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    assert [r["recommended_action"] for r in out] == ["ALLOW", "STEP_UP_AUTH", "STEP_UP_AUTH", "REVIEW", "REVIEW", "BLOCK"]


def test_all_points_and_codes(spark):
    out = _decided(spark, [("2000.00", "MOBILE", 90, ["MFA_BYPASS", "SHARED_DEVICE_NETWORK"], True, "HIGH"), ("5.00", "ECOMMERCE", None, None, None, None)])
    assert out[0]["risk_score"] == 100
    assert out[0]["reason_codes"] == ["HIGH_VALUE_PAYMENT", "REMOTE_PAYMENT_CHANNEL", "SHARED_DEVICE_NETWORK", "HIGH_RISK_CUSTOMER_SEGMENT", "MFA_BYPASS"]
    assert (out[1]["risk_score"], out[1]["behavioral_risk_score"], out[1]["linked_customer_count"]) == (5, 0, 0)
    assert out[1]["policy_version"] == "2026.09.1"


def test_decision_guard(spark):
    with pytest.raises(Exception, match="risk_score_bounded"):
        _decided(spark, [("1.00", "TRANSFER", -1, None, False, "LOW")])


def test_behaviour_one_sided_and_codes(spark):
    auth = conform(fixture.authentication(spark), feeds.AUTHENTICATION, "a")
    devices = conform(fixture.devices(spark), feeds.DEVICE, "d")
    one, other = auth.filter("customer_id = 'cus_00000000'"), devices.filter("customer_id = 'cus_00000001'")
    rows = {r["customer_id"]: r for r in beh.behavioral_features(beh.auth_flags(one), beh.device_flags(other)).collect()}
    assert set(rows) == {"cus_00000000", "cus_00000001"}
    assert rows["cus_00000000"]["observed_device_count"] == 0 and rows["cus_00000001"]["authentication_count"] == 0
    assert rows["cus_00000000"]["last_device_observation_at"] is None


@pytest.mark.parametrize("failures,codes", [(2, []), (3, ["REPEATED_LOGIN_FAILURES"])])
def test_failed_login_boundary(spark, failures, codes):
    auth = conform(fixture.authentication(spark, failures), feeds.AUTHENTICATION, "a").withColumn("user_agent", F.lit("x")).withColumn("customer_id", F.lit("c"))
    none = conform(fixture.devices(spark, 1).filter("false"), feeds.DEVICE, "d")
    row = beh.behavioral_features(beh.auth_flags(auth), beh.device_flags(none)).first()
    assert (row["behavioral_risk_score"], row["reason_codes"]) == (4 * failures, codes)


def test_access_boundary_and_alerts(spark):
    base = conform(fixture.access(spark, 2), feeds.ACCESS, "x").withColumn("privileged_access", F.lit(False)).withColumn("role_name", F.lit("r"))
    rows = base.withColumn("rows_accessed", F.expr("CASE WHEN source_sequence = 1 THEN 9999L ELSE 10000L END"))
    signals = acc.access_signals(acc.access_flags(rows))
    assert sorted((r["actor_id"], r["access_risk_score"]) for r in signals.collect()) == [("usr_00000000", 0), ("usr_00000001", 25)]
    alert = acc.access_alerts(signals, Settings()).collect()
    assert [(a["risk_level"], a["recommended_action"]) for a in alert] == [("MEDIUM", "REVIEW")]
    graded = spark.createDataFrame([("a", "r", s) for s in (24, 49, 50, 79, 80)], "actor_id string, role_name string, access_risk_score bigint")
    assert [r["risk_level"] for r in acc.access_alerts(graded, Settings()).orderBy("access_risk_score").collect()] == ["MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    empty = acc.access_signals(acc.access_flags(rows.withColumn("privileged_access", F.lit(None).cast("boolean")).withColumn("rows_accessed", F.lit(None).cast("bigint"))))
    assert {r["access_risk_score"] for r in empty.collect()} == {0}


def test_model_bands(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.35, 0.351, 0.6, 0.61, 0.8, 0.81, 1.0)], "fraud_probability double")
    out = [r["ml_risk_level"] for r in mdl.ml_actions(df).collect()]
    assert out == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]


def test_explanations(spark):
    zero = ", ".join(f"0L AS {c}" for c in mdl.NUMERIC_FEATURES[1:-2])
    df = spark.sql(
        f"SELECT 1, CAST(1500 AS decimal(18,2)) AS amount, {zero}, 2L AS linked_customer_count, 'HIGH' AS risk_segment "
        f"UNION ALL SELECT 2, CAST(1499.99 AS decimal(18,2)), {zero}, 2L, 'LOW' "
        f"UNION ALL SELECT 3, CAST(NULL AS decimal(18,2)), {zero}, 3L, 'UNKNOWN'"
    )
    assert [r["explanation_signals"] for r in mdl.explain(df).orderBy("1").collect()] == [
        ["HIGH_VALUE_PAYMENT", "HIGH_RISK_CUSTOMER_SEGMENT"], ["NO_ELEVATED_INPUT_SIGNAL"], ["SHARED_DEVICE_NETWORK"],
    ]


def test_class_guards(spark):
    frame = spark.range(100).selectExpr("id % 10 AS split_bucket", "int(id % 2) AS label")
    assert sum(mdl.check_classes(frame)["train"].values()) == 80
    with pytest.raises(ValueError, match="both classes"):
        mdl.check_classes(frame.filter("label = 0"))
    with pytest.raises(ValueError, match="test part"):
        mdl.check_classes(frame.filter("split_bucket < 8 OR label = 0"))


def test_split_is_disjoint_complete_repeatable(spark):
    frame = spark.range(2000).selectExpr("concat('e', id) AS event_id", "pmod(xxhash64(concat('e', id)), 10) AS split_bucket")
    train, test = mdl.split(frame)
    a, b = {r[0] for r in train.select("event_id").collect()}, {r[0] for r in test.select("event_id").collect()}
    assert not a & b and len(a | b) == 2000 and 0.15 < len(b) / 2000 < 0.25
    assert {r[0] for r in mdl.split(frame.repartition(7))[1].select("event_id").collect()} == b


def test_empty_scoring_is_refused(spark):
    empty = conform(fixture.payments(spark, 10).filter("false"), PAY, "p")
    with pytest.raises(ValueError, match="at least one payment"):
        mdl.check_rows(empty)


def test_tokens(spark):
    import hashlib

    out = spark.sql("SELECT 'cus_1' AS customer_id").selectExpr(f"{gov.token('cus_', 'ns', 'customer_id')} AS t").first()["t"]
    assert out == "cus_" + hashlib.sha256(b"ns|cus_1").hexdigest()[:16]
    with pytest.raises(ValueError):
        gov.protected(spark.range(1), "")


def _landing(spark, **expected):
    feed = fixture.all_feeds(spark)
    pay = feed.pop("payment")
    rec.check_landing(pay, feed, {"payment": 1000, "customer_change": 200, "authentication": 500, "device_intelligence": 500, "access": 200, **expected})


def test_landing(spark):
    _landing(spark)
    with pytest.raises(ValueError, match="access: 200 rows, expected 201"):
        _landing(spark, access=201)
    with pytest.raises(ValueError, match="1 bad amounts"):
        rec.check_landing(_payments(spark, amount=["-1"]).withColumn("amount", F.col("amount").cast("double")), {}, {"payment": 1})


def test_feedback_log(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    columns = "feedback_id string, transaction_id string, model_name string, model_version string, analyst_id string, disposition string, analyst_notes string, reviewed_at timestamp, recorded_at timestamp"
    row = ("f1", "t1", "m", "1", "a1", "CONFIRMED_FRAUD", None, at, at)
    path = str(tmp_path / "feedback")
    for _ in range(2):
        sinks.append_feedback(spark.createDataFrame([row], columns), path)
    assert spark.read.parquet(path).count() == 2
    for i, bad in ((4, None), (5, "MAYBE"), (7, None)):
        broken = spark.createDataFrame([row[:i] + (bad,) + row[i + 1 :]], columns)
        assert sinks.rejected_feedback(broken).count() == 1
        with pytest.raises(Exception, match="expectation failed"):
            sinks.append_feedback(broken, path)
    with pytest.raises(ValueError, match="columns"):
        sinks.append_feedback(spark.range(1), path)
    assert spark.read.parquet(path).count() == 2


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "json")
    df = fixture.authentication(spark, 7).withColumn("event_timestamp", F.expr("timestampadd(MICROSECOND, 17, event_timestamp)"))
    sinks.write_json_lines(df, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert len(lines) == 7
    for line in lines:
        assert list(json.loads(line)) == sorted(df.columns)
    assert any(json.loads(line)["failure_reason"] is None for line in lines)
    back = spark.read.schema(df.schema).json(path)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        sinks.newest_version(spark, root)
    sinks.write_version(spark.range(1), root, "0001")
    sinks.write_version(sinks.read_version(spark, root).selectExpr("id", "id + 1 AS more"), root, "0002")
    (tmp_path / "v" / "version=0003").mkdir()
    numbers = str(tmp_path / "n")
    for number in ("9", "10", "2"):
        sinks.write_version(spark.range(int(number)), numbers, number)
    assert sinks.newest_version(spark, numbers).endswith("version=10")
    assert sinks.newest_version(spark, root).endswith("version=0002")
    assert sinks.read_version(spark, root).columns == ["id", "more"]


def _health(spark, scored_at="2026-01-01 00:00:00", p=0.5, agree=True, f1=0.9, rows=2, held=0, shown=None):
    scored = spark.range(rows).selectExpr(f"{p}D AS fraud_probability", f"timestamp'{scored_at}' AS scored_at", f"{str(agree).lower()} AS model_policy_action_agreement")
    log = spark.sql(f"SELECT timestamp'2026-01-01' AS evaluated_at, {f1 or 0}D AS f1, 0.9D AS roc_auc UNION ALL SELECT timestamp'2025-01-01', 0.1D, 0.1D")
    counts = spark.sql(f"SELECT 'accepted' AS status, 95L AS row_count UNION ALL SELECT 'quarantined', {held}L")
    return hea.health(scored, log if f1 else log.filter("false"), counts, spark.range(rows if shown is None else shown), now=F.lit("2026-01-01 02:00:00").cast("timestamp"))


def _status(df):
    return {r["control_id"][-1]: r["control_status"] for r in df.collect()}


def test_health_states(spark):
    good = dict.fromkeys("1234567", "PASS")
    assert _status(_health(spark)) == good
    assert _status(_health(spark, scored_at="2025-12-31 23:59:00")) == {**good, "3": "FAIL"}
    assert _status(_health(spark, p=1.5, agree=False)) == {**good, "2": "FAIL", "4": "WARN"}
    assert _status(_health(spark, f1=0.59, held=5)) == {**good, "5": "FAIL"}
    assert _status(_health(spark, f1=None, held=6)) == {**good, "5": "FAIL", "6": "WARN"}
    assert _status(_health(spark, shown=1)) == {**good, "7": "FAIL"}
    assert _status(_health(spark, rows=0)) == {**good, "1": "FAIL", "2": "FAIL", "3": "FAIL", "4": "WARN"}


def test_enforce(spark):
    hea.enforce(_health(spark, held=50))
    with pytest.raises(RuntimeError, match="1 critical"):
        hea.enforce(_health(spark, shown=1))


def test_labels_do_not_reach_decisions_or_model_inputs(spark):
    assert "scenario_label" not in dec.DECISION_COLUMNS and "scenario_label" not in mdl.FEATURES
    df = _enriched(spark, [("1.00", "TRANSFER", 0, None, None, None)])
    dec.decide(df, Settings())  # runs without the label column being there
    mdl.fill_features(df.selectExpr("*", *[f"0L AS {c}" for c in mdl.NUMERIC_FEATURES[1:-2]])).select(*mdl.SCORING_IDS, *mdl.FEATURES)


def test_partitioned_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id % 5) END AS day")
    for _ in range(2):
        sinks.append_partitioned(df.repartition(8), path, "day")
    back = spark.read.parquet(path)
    assert back.count() == 2000 and back.filter("day = 'hot'").count() == 668
    files = [f for f in (tmp_path / "p").rglob("*.parquet")]
    assert len(files) <= 2 * 2 * 6  # a few per day and write, not one per task and day
    other = str(tmp_path / "r")
    sinks.replace(df, other)
    sinks.replace(df.selectExpr("id", "day", "1 AS more").limit(3), other)
    assert spark.read.parquet(other).columns == ["id", "day", "more"] and spark.read.parquet(other).count() == 3


def test_training_part_needs_both_classes(spark):
    zero = ", ".join(f"0L AS {c}" for c in mdl.NUMERIC_FEATURES[1:])
    train = spark.range(20).selectExpr("1 AS label", "double(id) AS amount", zero.split(", ")[0], *zero.split(", ")[1:], "'CAD' AS currency", "'MOBILE' AS payment_channel", "'LOW' AS risk_segment")
    with pytest.raises(ValueError, match="training part"):
        mdl.fit(train, trees=2)
