"""Rule sets over rows: accept, quarantine with reasons, count, or stop.

A rule set maps a rule name to a SQL predicate. A predicate that is NULL counts as
broken, so each row lands in exactly one of accepted and quarantined and each
broken rule is named.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.columns import one_of, with_expr
from riskweave.functions.conform import MALFORMED
from riskweave.sources.feeds import Feed

REASONS = "_quarantine_reasons"
STATUS = "_status"
ACCEPTED, QUARANTINED = "accepted", "quarantined"


def _predicates(rules: dict[str, str], df: DataFrame | None) -> list[str]:
    extra = [f"{MALFORMED} = ''"] if df is not None and MALFORMED in df.columns else []
    return [*rules.values(), *extra]


def all_hold(rules: dict[str, str], df: DataFrame | None = None) -> str:
    """True, false or NULL: the plain conjunction, which parquet scans can push down."""
    return " AND ".join(f"({p})" for p in _predicates(rules, df))


def failed_rules(rules: dict[str, str], df: DataFrame | None = None) -> str:
    """Names of the broken rules in rule order, joined by commas ('' if none)."""
    names = [f"CASE WHEN {p} THEN NULL ELSE '{name}' END" for name, p in rules.items()]
    if df is not None and MALFORMED in df.columns:
        names.append(f"nullif({MALFORMED}, '')")
    return f"concat_ws(',', {', '.join(names)})"


def accepted(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that meet every rule."""
    return df.filter(all_hold(rules, df)).drop(MALFORMED)


def invalid(rules: dict[str, str], df: DataFrame | None = None) -> str:
    """True for the rows that ``accepted`` leaves out, never NULL."""
    return f"NOT coalesce({all_hold(rules, df)}, false)"


def quarantined(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The other rows, with the names of the rules they break."""
    return (
        df.filter(invalid(rules, df))
        .withColumns({REASONS: F.expr(failed_rules(rules, df)), "_quarantined_at": F.current_timestamp()})
        .drop(MALFORMED)
    )


def tagged(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Every row with its status and reasons, for one write that serves both outcomes.

    Written with ``partitionBy("_status")`` the source is read once, and a reader of
    either side prunes the other side's files.
    """
    marked = df.withColumn(REASONS, F.expr(failed_rules(rules, df)))
    return with_expr(
        marked,
        **{
            STATUS: f"CASE WHEN {REASONS} = '' THEN '{ACCEPTED}' ELSE '{QUARANTINED}' END",
            "_quarantined_at": f"CASE WHEN {REASONS} <> '' THEN current_timestamp() END",
        },
    ).drop(MALFORMED)


def side(df: DataFrame, status: str) -> DataFrame:
    """One side of a tagged table, with the columns that side has by itself."""
    rows = df.filter(F.col(STATUS) == status).drop(STATUS)
    return rows.drop(REASONS, "_quarantined_at") if status == ACCEPTED else rows


def violation_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule: rows seen and rows that break it. Keeps no row back."""
    counts = df.agg(
        F.expr("count(*) AS checked_count"),
        *[F.expr(f"count_if(NOT coalesce({p}, false)) AS {n}") for n, p in rules.items()],
    )
    named = ", ".join(f"'{n}', {n}" for n in rules)
    return counts.selectExpr("checked_count", f"stack({len(rules)}, {named}) AS (rule_name, violation_count)")


def observed(df: DataFrame, rules: dict[str, str]) -> tuple[Observation, DataFrame]:
    """The frame with its rules counted as rows pass, and where the counts are found once an action has
    run over it. Nothing is read twice for them. Of a stream use ``observed_stream``."""
    seen = Observation()
    return seen, df.observe(seen, *_metrics(rules))


def observed_stream(df: DataFrame, rules: dict[str, str], name: str) -> DataFrame:
    """A stream with its rules counted per micro-batch; the counts are in the progress of the query
    (``observedMetrics``, under ``name``)."""
    return df.observe(name, *_metrics(rules))


def _metrics(rules: dict[str, str]) -> list[Column]:
    return [F.expr("count(1)").alias("checked_count"), *[F.expr(f"count_if(NOT coalesce({p}, false))").alias(n) for n, p in rules.items()]]


def observed_counts(spark: SparkSession, rules: dict[str, str], metrics: Mapping[str, int]) -> DataFrame:
    """Observed counts in the form of ``violation_counts``, one row a rule."""
    rows = [(int(metrics["checked_count"]), n, int(metrics[n])) for n in rules]
    return spark.createDataFrame(rows, "checked_count long, rule_name string, violation_count long")


def require(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Pass rows through; the job fails at the first row that breaks a rule.

    The check reads finished columns. Without the marker column, whose value Spark will
    not compute twice, the optimizer would move the check below the projection that
    computes those columns and so compute each of them again, once per use.
    """
    checks = [
        f"CASE WHEN {p} THEN true ELSE cast(raise_error('expectation failed: {name}') AS boolean) END"
        for name, p in rules.items()
    ]
    marked = df.withColumn("_marker", F.spark_partition_id())
    return marked.filter(" AND ".join(["_marker >= 0", *checks])).drop("_marker")


def contract_rules(feed: Feed) -> dict[str, str]:
    """The feed's contract as a rule set, stricter than its Bronze rules."""
    rules: dict[str, str] = {}
    for f in feed.fields:
        checks: dict[str, str] = {}
        if f.length is not None:
            low, high = f.length
            checks["min_length"] = f"length({f.name}) >= {low}"
            if high is not None:
                checks["max_length"] = f"length({f.name}) <= {high}"
        if f.allowed:
            checks["allowed"] = one_of(f.name, f.allowed)
        if f.minimum is not None:
            checks["minimum"] = f"{f.name} >= {f.minimum}"
        if f.above is not None:
            checks["above"] = f"{f.name} > {f.above}"
        if f.maximum is not None:
            checks["maximum"] = f"{f.name} <= {f.maximum}"
        if f.always is not None:
            checks["constant"] = f"{f.name} = {str(f.always).lower()}"
        if not f.nullable:
            rules[f"{f.name}_required"] = f"{f.name} IS NOT NULL"
        # An absent value is the required rule's business, not the limits'.
        for kind, predicate in checks.items():
            rules[f"{f.name}_{kind}"] = f"{f.name} IS NULL OR {predicate}"
    return rules


def check_columns(df: DataFrame, feed: Feed) -> DataFrame:
    """Closed column set: raise when a raw frame lacks or adds a column."""
    missing = [c for c in feed.columns if c not in df.columns]
    extra = [c for c in df.columns if c not in feed.columns]
    if missing or extra:
        raise ValueError(f"{feed.name}: missing columns {missing}, unexpected columns {extra}")
    return df
