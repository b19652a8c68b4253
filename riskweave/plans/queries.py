"""One query per operator (or natural group of operators) over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import columns as fn
from riskweave.functions.conform import MALFORMED
from riskweave.operators import access as acc
from riskweave.operators import behavior as beh
from riskweave.operators import decisions as dec
from riskweave.operators import edges as edg
from riskweave.operators import expectations as exp
from riskweave.operators import governance as gov
from riskweave.operators import health as hea
from riskweave.operators import model as mdl
from riskweave.operators import reconcile as rec
from riskweave.operators.evaluation import evaluate, latest_evaluation, score_curve
from riskweave.operators.forest import descend, node_table
from riskweave.operators.identity import resolve_identity
from riskweave.operators.latest import CUSTOMER_SEQUENCE, current_customers, dedup_batch
from riskweave.operators.median import exact_medians
from riskweave.operators.payments import PAYMENT_ORDER, payment_dates
from riskweave.plans import layers as lay
from riskweave.settings import SESSION_CONF
from riskweave.sources import drivertables as raw
from riskweave.sources import feeds, views
from riskweave.sources.rollups import add_batch, merged
from riskweave.sources.readers import (
    accepted_stream,
    discard,
    fresh_path,
    kept,
    stream,
)
from riskweave.sources.sinks import (
    append_feedback,
    append_feedback_once,
    append_once,
    append_partitioned,
    land,
    land_counted,
    read_batches,
    read_version,
    rejected_feedback,
    replace,
    write_json_lines,
    write_version,
)
from riskweave.streaming.cdc import compact_changes, fold_changes, folded_state
from riskweave.streaming.dedup import dedup_stream
from riskweave.streaming.handover import Handover
from riskweave.streaming.ingest import land_stream, run_available, run_batches
from riskweave.streaming.late import arrival_counts, on_time_stream, route_late

Query = Callable[[SparkSession, str], DataFrame]

# Run times, which differ from run to run.
VOLATILE = {
    "_ingested_at", "_conformed_at", "_quarantined_at", "feature_calculated_at",
    "network_feature_calculated_at", "decisioned_at", "created_at", "alerted_at",
    "metrics_calculated_at", "checked_at", "validated_at", MALFORMED,
}


def comparable(df: DataFrame) -> DataFrame:
    """Leave out run times and give times, money and arrays one form in both engines."""

    def form(field: T.StructField) -> str:
        c = f"`{field.name}`"
        if isinstance(field.dataType, T.TimestampType):
            c = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif isinstance(field.dataType, T.DateType):
            c = f"string({c})"
        elif isinstance(field.dataType, T.DecimalType):
            c = f"double({c})"
        elif isinstance(field.dataType, T.ArrayType):
            c = f"array_join({c}, ',')"
        return f"{c} AS `{field.name}`"

    return df.selectExpr(*[form(f) for f in df.schema if f.name not in VOLATILE])


def _staged(feed: str) -> Query:
    return lambda s, d: lay.staged(s, d, feed)


def _accepted(feed: str) -> Query:
    return lambda s, d: lay.bronze(s, d, feed)


def _quarantined(feed: str) -> Query:
    return lambda s, d: exp.quarantined(lay.staged(s, d, feed), feeds.FEEDS[feed].rules)


def _contract(feed: str) -> Query:
    def run(s, d):
        spec = feeds.FEEDS[feed]
        exp.check_columns(lay.RAW[feed](s, d), spec)
        return exp.quarantined(lay.as_sent(s, d, feed), exp.contract_rules(spec)).select(
            spec.key, exp.REASONS
        )

    return run


def _dedup(feed: str, order: tuple[str, ...]) -> Query:
    return lambda s, d: dedup_batch(lay.bronze(s, d, feed), feeds.FEEDS[feed].key, order)


def _kept(rows):
    """The rows stored, without the stored layers that they come from."""
    out = kept(rows)
    discard(rows)
    return out


def s3_batch_scan(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


def s4_shared_stage(s, d):
    tagged = exp.tagged(lay.staged(s, d, "payment"), feeds.PAYMENT.rules)
    return tagged.groupBy(exp.STATUS, exp.REASONS).agg(F.count(F.lit(1)).alias("row_count"))


def q7_invalid_counts(s, d):
    flagged = {
        feed: lay.staged(s, d, feed).filter(exp.invalid(spec.rules, lay.staged(s, d, feed)))
        for feed, spec in feeds.FEEDS.items()
    }
    return rec.feed_counts(flagged)


def q10_violation_counts(s, d):
    """The rules of all five feeds, one scan a feed."""
    counts = [exp.violation_counts(lay.staged(s, d, n), f.rules) for n, f in feeds.FEEDS.items()]
    return reduce(DataFrame.unionByName, counts)


def q14_feed_counts(s, d):
    return rec.feed_counts({feed: lay.RAW[feed](s, d) for feed in feeds.FEEDS})


def d1_identity(s, d):
    return resolve_identity(current_customers(lay.bronze(s, d, "customer_change")))


def p7_clean_text(s, d):
    changes = lay.bronze(s, d, "customer_change")
    return changes.select(
        "change_id",
        fn.as_column(fn.clean_upper("country"), "country"),
        fn.as_column(fn.clean_upper("risk_segment"), "risk_segment"),
    )


def p8_payment_dates(s, d):
    return payment_dates(lay.payments(s, d)).select("event_id", "event_timestamp", "event_date")


def p9_auth_flags(s, d):
    return lay.authentication(s, d).select(
        "auth_event_id", "is_failed_login", "is_mfa_bypass", "is_headless_client"
    )


def p10_device_flags(s, d):
    return lay.devices(s, d).select(
        "device_event_id", "is_anonymized_network", "is_untrusted_device"
    )


def p11_access_flags(s, d):
    return lay.access(s, d).select(
        "access_event_id", "is_bulk_access", "is_privileged_after_hours"
    )


def u1_edge_rows(s, d):
    rows = edg.edge_rows(lay.payments(s, d))
    return rows.groupBy("edge_type", "source_type", "target_type", "currency").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("amount").alias("amount"),
        F.count_distinct("source_id").alias("sources"),
        F.count_distinct("target_id").alias("targets"),
    )


def a1_edges(s, d):
    return edg.transaction_edges(lay.payments(s, d))


def q15_device_edges(s, d):
    return edg.device_edges(edg.transaction_edges(lay.payments(s, d)))


def a5_network_from_edges(s, d):
    return edg.device_network(edg.transaction_edges(lay.payments(s, d), ("USES",)))


def j6_enriched(s, d):
    return lay.enriched(s, d).select(
        "event_id", "customer_id", "device_id", "risk_segment", "resolved_identity_id",
        "failed_login_count", "impossible_travel_count", "behavioral_risk_score",
        "linked_customer_count", "network_transaction_count", "is_shared_device",
    )


def d9_rule_scores(s, d):
    return dec.rule_scores(lay.enriched(s, d)).select(
        "event_id", "amount_rule_score", "channel_rule_score", "shared_device_rule_score",
        "customer_segment_score", "behavioral_risk_score", "linked_customer_count",
        "network_transaction_count", "network_total_amount", "is_shared_device", "risk_segment",
        "risk_score",
    )


def d16_cases(s, d):
    return dec.investigation_queue(lay.decisions(s, d))


def d17_alerts(s, d):
    return acc.access_alerts(lay.signals(s, d), lay.SETTINGS)


def a6_decision_metrics(s, d):
    return dec.decision_metrics(lay.decisions(s, d))


def a10_global_aggregates(s, d):
    return lay.payment_scores(s, d).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("fraud_probability").alias("minimum"),
        F.max("fraud_probability").alias("maximum"),
        F.round(F.avg("fraud_probability"), 6).alias("average"),
    )


def m1_training_frame(s, d):
    return mdl.training_frame(lay.enriched(s, d)).drop("split_bucket")


def m2_split(s, d):
    """Per label: rows, rows in a part, and in both. A row's part follows from its bucket, so
    one pass shows that the parts cover the frame and do not meet."""
    frame = mdl.training_frame(lay.enriched(s, d))
    in_train, in_test = mdl.part_conditions()
    return frame.groupBy("label").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(in_train | in_test).alias("in_a_part"),
        F.count_if(in_train & in_test).alias("in_both"),
        F.expr("abs(count_if(split_bucket >= 8) / count(*) - 0.2) < 0.05").alias("a_fifth_tests"),
    )


def a9_class_counts(s, d):
    return mdl.class_counts(lay.payment_scores(s, d))


def m7_evaluation(s, d):
    one = evaluate(lay.payment_scores(s, d))
    return one.select(
        *[F.round(c, 9).alias(c) for c in ("roc_auc", "pr_auc", "precision", "recall", "f1")],
        "test_row_count",
    )


def m7_score_curve(s, d):
    return score_curve(lay.payment_scores(s, d), "label", "fraud_probability")


def m4_medians(s, d):
    """Exact medians of all inputs over the whole training frame."""
    medians = exact_medians(mdl.training_frame(lay.enriched(s, d)), mdl.NUMERIC_FEATURES)
    return s.createDataFrame(list(medians.items()), "feature string, median double").withColumn("median", F.round("median", 6))


def m6_descent(s, d):
    """A fitted forest's probability of every payment, beside that of a descent through its node table.
    ``separates``: the forest ranks the classes of the rows it learnt from apart, which no constant does.
    (Labels of the given tables do not depend on the inputs, so the test part has nothing to rank by.)"""
    depth, rows = 8, _kept(lay.stored_enriched(s, d))
    frame = mdl.training_frame(rows)
    train, _ = mdl.split(frame)
    model = mdl.fit(train, trees=40, depth=depth)
    ranked = evaluate(mdl.predict(model, train)).first()
    scored = model.transform(mdl.as_double(frame)).select("event_id", "features", "probability")
    p = vector_to_array("probability")[1]
    return descend(scored, node_table(s, model), depth).select(
        "event_id",
        (F.abs(p - F.col("descent_probability")) <= 1e-9).alias("descent_follows"),
        F.lit(ranked["roc_auc"] > 0.5).alias("separates"),
    )


def m9_model_scoring(s, d):
    """Fit on the training part, score every payment and set it beside the policy."""
    rows = _kept(lay.stored_enriched(s, d))
    frame = mdl.training_frame(rows)
    mdl.check_classes(frame)
    model = mdl.fit(mdl.split(frame)[0])
    tags = {"name": "fraud_model", "version": "1", "alias": "current"}
    out = mdl.score_beside_policy(model, rows, tags, lay.SETTINGS)
    p, action = F.col("fraud_probability"), F.col("ml_recommended_action")
    level = F.when(p <= 0.35, "LOW").when(p <= 0.6, "MEDIUM").when(p <= 0.8, "HIGH").otherwise("CRITICAL")
    actions = F.create_map(*[F.lit(v) for v in ("LOW", "ALLOW", "MEDIUM", "STEP_UP_AUTH", "HIGH", "REVIEW", "CRITICAL", "BLOCK")])
    # The forest's numbers have no counterpart; what must hold of them whatever they are, has.
    return out.select(
        "event_id", "transaction_id", "customer_id", "policy_risk_score", "policy_risk_level",
        "policy_recommended_action", "policy_reason_codes", "explanation_signals",
        "registered_model_name", "registered_model_version", "model_alias",
        p.between(0, 1).alias("probability_bounded"),
        (F.col("ml_prediction") == (p >= 0.5).cast("int")).alias("prediction_follows"),
        (F.col("ml_risk_level") == level).alias("level_follows"),
        (action == actions[F.col("ml_risk_level")]).alias("action_follows"),
        (F.col("model_policy_action_agreement") == (action == F.col("policy_recommended_action"))).alias("agreement_follows"),
        (F.abs(F.col("model_policy_risk_gap") - (p * 100 - F.col("policy_risk_score"))) <= 0.0051).alias("gap_follows"),
    )


def m10_bands(s, d):
    return mdl.ml_actions(lay.payment_scores(s, d)).select(
        "event_id", "fraud_probability", "ml_prediction", "ml_risk_level", "ml_recommended_action"
    )


def m11_explanations(s, d):
    return lay.scored_of(lay.enriched(s, d)).select("event_id", "explanation_signals")


def m13_scoring_metrics(s, d):
    return mdl.scoring_metrics(lay.compared(s, d))


def o1_ordered_report(s, d):
    rows = mdl.scoring_metrics(lay.stored_compared(s, d))
    return rows.orderBy(F.desc("average_fraud_probability")).select(
        "ml_risk_level", "average_fraud_probability"
    )


def m14_feedback_valid(s, d):
    return exp.accepted(lay.feedback(s, d), _feedback_rules())


def _feedback_rules():
    from riskweave.operators.feedback import FEEDBACK_RULES

    return FEEDBACK_RULES


def m14_feedback_rejected(s, d):
    return rejected_feedback(lay.feedback(s, d)).select("feedback_id", exp.REASONS)


def g2_protected_view(s, d):
    return gov.protected_view(
        lay.stored_compared(s, d), lay.SETTINGS.token_namespace, "secure_investigator_transactions"
    )


def h_health(s, d):
    rows = _kept(lay.stored_compared(s, d))
    counts = hea.status_counts(
        {feed: exp.tagged(lay.staged(s, d, feed), spec.rules) for feed, spec in feeds.FEEDS.items()}
    )
    return hea.health(
        rows,
        lay.daily_evaluations(s, d),
        counts,
        gov.protected(rows, lay.SETTINGS.token_namespace),
        now=F.lit("2026-01-01 01:30:00").cast("timestamp"),
    )


#: Files of a part of the fixture stream.
FILES = 4


def _as_stream(s, df, parts):
    """The rows as a stream that takes one part per trigger: each is ``FILES`` files, written by so many
    tasks, and the files of a part are taken together."""
    path = fresh_path(s, "arrivals")
    for part in parts:
        df.filter(part).repartition(FILES).write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
    return stream(s, path, df.schema, maxFilesPerTrigger=str(FILES))


def _event_stream(s, d, again=False):
    """The events in the order of their ids, in two parts; with ``again`` a share of them is delivered
    once more at the end."""
    events = s.read.parquet(f"{d}/events.parquet")
    middle = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0] or 0
    parts = [f"event_id <= {middle}", f"event_id > {middle}"] + ["event_id % 20 = 7"] * again
    return raw.with_k(_as_stream(s, events, parts))


def t2_stream_auth(s, d):
    """Bronze landing and Silver deduplication as two triggered streams."""
    bronze, silver = fresh_path(s, "auth-bronze"), fresh_path(s, "auth-silver")
    land_stream(
        raw.authentication_of(_event_stream(s, d, again=True)), feeds.AUTHENTICATION, "authentication",
        bronze, f"{bronze}-log",
    )
    once = exp.require(
        dedup_stream(
            accepted_stream(s, bronze, feeds.AUTHENTICATION), "auth_event_id", "event_timestamp",
            lay.SETTINGS.watermark, lay.SETTINGS.stream_splits,
        ),
        feeds.AUTHENTICATION_GUARD,
    )
    run_available(beh.auth_flags(once), silver, f"{silver}-log")
    return s.read.parquet(silver).select(
        "auth_event_id", "is_failed_login", "is_mfa_bypass", "is_headless_client"
    )


def t4_stream_customers(s, d):
    """Customer changes folded batch by batch into current state."""
    from riskweave.functions.conform import conform

    spec = feeds.CUSTOMER_CHANGE
    changes = exp.accepted(
        conform(raw.customer_changes_of(_event_stream(s, d)), spec, spec.name), spec.rules
    )
    path = fresh_path(s, "customer-changes")
    run_batches(changes, fold_changes(path, ["customer_id"], CUSTOMER_SEQUENCE), f"{path}-log")
    return folded_state(
        s, path, ["customer_id"], CUSTOMER_SEQUENCE, "operation = 'DELETE'",
        ["operation", "change_id"],
    )


def t4_merged_customers(s, d):
    """The same in three parts, of which the last one is merged into the buckets that its keys touch."""
    path, key = fresh_path(s, "customer-changes"), ["customer_id"]
    handle = fold_changes(path, key, CUSTOMER_SEQUENCE)
    changes = lay.bronze(s, d, "customer_change")
    for n, part in enumerate(("source_sequence % 3 = 0", "source_sequence % 3 = 1", "source_sequence % 3 = 2")):
        handle(changes.filter(part), n)
        if n != 1:
            compact_changes(s, path, key, CUSTOMER_SEQUENCE, buckets=8)
    return folded_state(s, path, key, CUSTOMER_SEQUENCE, "operation = 'DELETE'", ["operation", "change_id"])


_AUTH_COPIED = "cast(substr(md5(auth_event_id), 1, 1) AS string) = '7'"


def s2_backfill(s, d):
    """The first half of the time as a back-fill, the rest and copies from about the hand-over as a stream."""
    rows = lay.bronze(s, d, "authentication").select(*beh.AUTH_INPUTS)
    cut = rows.agg(F.expr("percentile_approx(unix_micros(event_timestamp), 0.5) AS t")).first()[0] or 0
    root = fresh_path(s, "handover")
    whole = Handover(
        f"{root}/table", f"{root}/inbox", f"{root}/log", rows.schema, "auth_event_id", "event_timestamp", lay.SETTINGS.watermark
    )
    before = f"unix_micros(event_timestamp) <= {cut}"
    whole.back_fill(rows.where(before), beh.AUTH_ORDER)
    again = f"unix_micros(event_timestamp) > {cut} - 43200000000 AND {_AUTH_COPIED}"
    whole.arrive(rows.where(f"NOT ({before})").unionByName(rows.where(again)), "1")
    whole.run(s)
    whole.run(s)
    return beh.auth_flags(exp.require(read_batches(s, root + "/table"), feeds.AUTHENTICATION_GUARD)).select(
        "auth_event_id", "is_failed_login", "is_mfa_bypass", "is_headless_client"
    )


def t1_late_rows(s, d):
    """What arrives, split into kept, copies and late: a share of the rows comes once more at the end, part of
    it behind the watermark."""
    rows = lay.bronze(s, d, "authentication").select("auth_event_id", "event_timestamp")
    cut = rows.agg(F.expr("percentile_approx(unix_micros(event_timestamp), 0.5) AS t")).first()[0] or 0
    parts = [f"unix_micros(event_timestamp) <= {cut}", f"unix_micros(event_timestamp) > {cut}", _AUTH_COPIED]
    path, once = fresh_path(s, "routed"), fresh_path(s, "once")
    arrivals = _as_stream(s, rows, parts)
    run_batches(arrivals, route_late(path, "event_timestamp", lay.SETTINGS.watermark), f"{path}-log")
    kept_rows = dedup_stream(on_time_stream(s, path, rows.schema), "auth_event_id", "event_timestamp", lay.SETTINGS.watermark)
    run_available(kept_rows, once, f"{once}-log")
    return arrival_counts(s, path, s.read.parquet(once))


def q10_observed_landing(s, d):
    """The payment rules counted by the write that lands the payments."""
    return land_counted(lay.staged(s, d, "payment"), feeds.PAYMENT.rules, fresh_path(s, "landed-payments"))


def q12_guarded_layers(s, d):
    """Rows of each layer behind its guard, which would fail on the first bad one."""
    names = ("payments", "customers", "authentication", "devices", "access", "decisions")
    return rec.feed_counts({name: getattr(lay, name)(s, d) for name in names})


def k1_landed_payments(s, d):
    """Both outcomes through one write, read back side by side."""
    path = fresh_path(s, "landed-payments")
    land(lay.staged(s, d, "payment"), feeds.PAYMENT.rules, path)
    return hea.status_counts({"payment": s.read.parquet(path)})


def k3_partitioned_append(s, d):
    """Two appends to one table, clustered by currency."""
    path = fresh_path(s, "payments-by-currency")
    rows = lay.bronze(s, d, "payment").select("event_id", "amount", "currency", "source_sequence")
    for odd in (0, 1):
        append_partitioned(rows.filter(f"source_sequence % 2 = {odd}"), path, "currency")
    return s.read.parquet(path)


def k4_replaced_table(s, d):
    """A table written again with another schema."""
    path = fresh_path(s, "signals")
    replace(lay.signals(s, d).select("actor_id"), path)
    replace(lay.signals(s, d), path)
    return s.read.parquet(path)


def k3_batches_once(s, d):
    """Two batches of accepted payments, the first one sent twice."""
    path = fresh_path(s, "payment-batches")
    rows = lay.bronze(s, d, "payment").select("event_id", "amount", "currency", "source_sequence")
    for odd in (0, 1, 0):
        append_once(rows.filter(f"source_sequence % 2 = {odd}"), path, str(odd), ["currency"])
    return read_batches(s, path)


def k6_feedback_once(s, d):
    """The feedback as a batch, the batch again, and its rows in a batch of another name."""
    path, rows = fresh_path(s, "feedback"), m14_feedback_valid(s, d)
    for name in ("a", "a", "b"):
        append_feedback_once(rows, path, name)
    return read_batches(s, path)


def k2_switched_table(s, d):
    """A table refreshed three times, each time through a manifest, with two versions kept."""
    root, rows = fresh_path(s, "signals"), lay.signals(s, d)
    for version, part in (("1", "access_risk_score > 50"), ("2", "false"), ("3", "true")):
        write_version(rows.where(part), root, version, keep=2)
    return read_version(s, root)


def k2_versioned_metrics(s, d):
    root = fresh_path(s, "metrics")
    write_version(dec.decision_metrics(lay.decisions(s, d)), root, "0001")
    return read_version(s, root)


def _by_batch(rows, rollup, name, rows_of):
    """A rollup of rows that come as three batches by time, each cut at a day's end, the second one sent twice."""
    s, root, stored = rows.sparkSession, fresh_path(rows.sparkSession, name), _kept(rows)
    days = stored.select(F.expr("unix_date(to_date(event_timestamp))").alias("day"))
    cuts = days.agg(F.expr("percentile_approx(day, array(0.6D, 0.9D))")).first()[0] or [0, 0]
    day = f"coalesce(unix_date(to_date(event_timestamp)), {cuts[0]})"
    parts = {"1": f"{day} <= {cuts[0]}", "2": f"{day} > {cuts[0]} AND {day} <= {cuts[1]}", "3": f"{day} > {cuts[1]}"}
    for batch_id in ("1", "2", "2", "3"):
        add_batch(rows_of(stored.where(parts[batch_id])), rollup, root, batch_id)
    return merged(s, rollup, root)


def a1_edges_by_batch(s, d):
    return edg.edges_of_rollup(_by_batch(lay.payments(s, d), edg.EDGE_ROLLUP, "edge-rollup", edg.rollup_rows))


def a5_network_by_batch(s, d):
    return edg.network_of_rollup(_by_batch(lay.payments(s, d), edg.DEVICE_ROLLUP, "device-rollup", lambda rows: rows))


def a6_metrics_by_batch(s, d):
    rows = lay.stored_decisions(s, d).select(*dec.METRICS_INPUTS)
    return dec.metrics_of_rollup(_by_batch(rows, dec.METRICS_ROLLUP, "metrics-rollup", dec.metrics_rows))


def k5_reopened_view(s, d):
    """The protected view over a stored table, defined, lost with its session name, and opened again."""
    root, name = fresh_path(s, "view"), "reopened_investigator_transactions"
    rows = lay.stored_compared(s, d)
    write_version(rows, f"{root}/scored", "1")
    discard(rows)
    views.save_view(s, f"{root}/views", name, f"{root}/scored")
    views.open_view(s, f"{root}/views", name, lay.SETTINGS.token_namespace)
    s.catalog.dropTempView(name)
    return views.open_view(s, f"{root}/views", name, lay.SETTINGS.token_namespace)


def k6_feedback_log(s, d):
    path = fresh_path(s, "feedback")
    append_feedback(m14_feedback_valid(s, d), path)
    return s.read.parquet(path)


def k7_json_lines(s, d):
    path = fresh_path(s, "alerts")
    alerts = d17_alerts(s, d)
    write_json_lines(alerts, path)
    return s.read.schema(alerts.schema).json(path)


def f1_casts(s, d):
    events = raw.with_k(s.read.parquet(f"{d}/events.parquet"))
    mixed = F.when(F.col("k") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return events.select(
        "event_id",
        mixed.try_cast("double").alias("as_double"),
        F.col("value").try_cast("decimal(18,2)").alias("as_decimal"),
        F.col("k").cast("string").try_cast("bigint").alias("as_long"),
        F.when(F.col("k") % 2 == 0, "true").when(F.col("k") % 5 == 0, "perhaps").otherwise("false").try_cast("boolean").alias("as_boolean"),
    )


def f2_text(s, d):
    customer = s.read.parquet(f"{d}/customer.parquet")
    return customer.select(
        "c_custkey",
        F.upper("c_name").alias("upper_name"),
        F.lower("c_name").alias("lower_name"),
        F.trim(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("trimmed_name"),
        F.lower("c_mktsegment").contains("build").alias("is_building"),
        F.concat_ws("|", "c_name", F.nullif("c_mktsegment", F.lit("MACHINERY"))).alias("joined"),
        F.substring("c_name", 1, 4).alias("head"),
    )


def f4_ids_and_hashes(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    return orders.select(
        fn.as_column(fn.padded_id("ord_", "o_orderkey", 16), "padded"),
        fn.as_column(fn.hashed_id("string(o_orderkey)", "o_orderpriority"), "hashed"),
        fn.as_column(fn.token("cus_", lay.SETTINGS.token_namespace, "string(o_custkey)"), "token"),
        fn.as_column(fn.cycle(("CAD", "USD", "EUR", "GBP"), "o_custkey"), "picked"),
    )


def f7_numbers(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.col("l_quantity").cast("decimal(18,2)") / 8, 2).alias("rounded"),
        F.least(F.lit(100), F.col("l_linenumber") * 25).alias("capped"),
        F.when(F.col("l_quantity") >= 40, "HIGH").when(F.col("l_quantity") >= 20, "MEDIUM").otherwise("LOW").alias("size"),
        F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("none")).alias("flag"),
        F.col("l_quantity").between(10, 20).alias("between_10_20"),
        F.col("l_linestatus").isin("F").alias("is_final"),
    )


def f9_times(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    at = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        F.to_date(at).alias("day"),
        F.unix_timestamp(at).alias("seconds"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("event_id") * 15).alias("stepped"),
    )


def f10_arrays(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    flags = fn.codes(
        [
            ("l_quantity >= 25", "LARGE"),
            ("l_discount > 0.05D", "DISCOUNTED"),
            ("l_returnflag = 'R'", "RETURNED"),
        ]
    )
    own = F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_returnflag"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        fn.as_column(flags, "flags"),
        fn.as_column(f"bigint(size({flags}))", "flag_count"),
        F.array_distinct(own).alias("distinct_flags"),
    )


def _plain(name: str) -> Query:
    """A layer as it stands."""
    return lambda s, d: getattr(lay, name)(s, d)


_QUERIES: dict[str, Query] = {
    "s3_batch_scan": s3_batch_scan,
    "s4_shared_stage": s4_shared_stage,
    "p1_conform_payments": _staged("payment"),
    "p2_conform_customers": _staged("customer_change"),
    "p3_conform_authentication": _staged("authentication"),
    "p4_conform_devices": _staged("device_intelligence"),
    "p5_conform_access": _staged("access"),
    "p7_clean_text": p7_clean_text,
    "p8_payment_dates": p8_payment_dates,
    "p9_auth_flags": p9_auth_flags,
    "p10_device_flags": p10_device_flags,
    "p11_access_flags": p11_access_flags,
    "q1_payment_accepted": _accepted("payment"),
    "q1_payment_quarantine": _quarantined("payment"),
    "q2_customer_accepted": _accepted("customer_change"),
    "q2_customer_quarantine": _quarantined("customer_change"),
    "q3_authentication_accepted": _accepted("authentication"),
    "q3_authentication_quarantine": _quarantined("authentication"),
    "q4_device_accepted": _accepted("device_intelligence"),
    "q4_device_quarantine": _quarantined("device_intelligence"),
    "q5_access_accepted": _accepted("access"),
    "q5_access_quarantine": _quarantined("access"),
    "q7_invalid_counts": q7_invalid_counts,
    "q10_violation_counts": q10_violation_counts,
    "q13_payment_contract": _contract("payment"),
    "q13_customer_contract": _contract("customer_change"),
    "q13_authentication_contract": _contract("authentication"),
    "q13_device_contract": _contract("device_intelligence"),
    "q13_access_contract": _contract("access"),
    "q14_landing_counts": lambda s, d: rec.payment_landing_counts(raw.payments(s, d)),
    "q14_feed_counts": q14_feed_counts,
    "q15_device_edges": q15_device_edges,
    "t2b_payment_dedup": _dedup("payment", PAYMENT_ORDER),
    "t2b_authentication_dedup": _dedup("authentication", beh.AUTH_ORDER),
    "t2b_device_dedup": _dedup("device_intelligence", beh.OBSERVATION_ORDER),
    "t2b_access_dedup": _dedup("access", acc.ACCESS_ORDER),
    "t2_stream_auth": t2_stream_auth,
    "t4a_current_customers": lambda s, d: current_customers(lay.bronze(s, d, "customer_change")),
    "t4_stream_customers": t4_stream_customers,
    "d1_identity": d1_identity,
    "u1_edge_rows": u1_edge_rows,
    "a1_edges": a1_edges,
    "a2_auth_features": lambda s, d: beh.auth_features(lay.authentication(s, d)),
    "a3_device_features": lambda s, d: beh.device_features(lay.devices(s, d)),
    "a4_access_signals": _plain("signals"),
    "a5_network_from_edges": a5_network_from_edges,
    "a5_device_network": _plain("network"),
    "j4_d3_behavior": _plain("behavior"),
    "j6_enriched": j6_enriched,
    "d9_rule_scores": d9_rule_scores,
    "d18_decisions": _plain("stored_decisions"),
    "d16_cases": d16_cases,
    "d17_alerts": d17_alerts,
    "a6_decision_metrics": a6_decision_metrics,
    "a8_scenario_summary": lambda s, d: rec.scenario_summary(lay.bronze(s, d, "payment")),
    "a9_class_counts": a9_class_counts,
    "a10_global_aggregates": a10_global_aggregates,
    "m1_training_frame": m1_training_frame,
    "m2_split": m2_split,
    "m7_evaluation": m7_evaluation,
    "m7_score_curve": m7_score_curve,
    "m4_medians": m4_medians,
    "m6_descent": m6_descent,
    "m9_model_scoring": m9_model_scoring,
    "m10_bands": m10_bands,
    "m11_explanations": m11_explanations,
    "j5_m12_compared": _plain("stored_compared"),
    "a7_m13_scoring_metrics": m13_scoring_metrics,
    "m14_feedback_valid": m14_feedback_valid,
    "m14_feedback_rejected": m14_feedback_rejected,
    "g2_protected_view": g2_protected_view,
    "h_health": h_health,
    "o1_ordered_report": o1_ordered_report,
    "o2_latest_row": lambda s, d: latest_evaluation(lay.daily_evaluations(s, d)),
    "q12_guarded_layers": q12_guarded_layers,
    "k1_landed_payments": k1_landed_payments,
    "k2_versioned_metrics": k2_versioned_metrics,
    "k2_switched_table": k2_switched_table,
    "a1_edges_by_batch": a1_edges_by_batch,
    "a5_network_by_batch": a5_network_by_batch,
    "a6_metrics_by_batch": a6_metrics_by_batch,
    "k5_reopened_view": k5_reopened_view,
    "k3_batches_once": k3_batches_once,
    "k6_feedback_once": k6_feedback_once,
    "q10_observed_landing": q10_observed_landing,
    "s2_backfill": s2_backfill,
    "t1_late_rows": t1_late_rows,
    "t4_merged_customers": t4_merged_customers,
    "k3_partitioned_append": k3_partitioned_append,
    "k4_replaced_table": k4_replaced_table,
    "k6_feedback_log": k6_feedback_log,
    "k7_json_lines": k7_json_lines,
    "f1_casts": f1_casts,
    "f2_text": f2_text,
    "f4_ids_and_hashes": f4_ids_and_hashes,
    "f7_numbers": f7_numbers,
    "f9_times": f9_times,
    "f10_arrays": f10_arrays,
}


def queries() -> dict[str, Query]:
    def shown(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for name in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
                spark.conf.set(name, SESSION_CONF[name])
            return comparable(query(spark, sf_dir))

        return run

    return {name: shown(query) for name, query in _QUERIES.items()}
