"""Aggregates that are kept up to date batch by batch, a day's rows at a time.

A rollup is a table of partial rows per batch, and for each distinct count a table of the values that
each group has shown. A batch adds its own partial rows and the values that are new; what
earlier batches wrote is neither aggregated nor written again. Partial rows merge by sum, minimum and
maximum, a distinct count by the sum of the new values, so that the result is that of one
aggregation over all rows, whatever the order of the batches. Groups and values compare as in
``groupBy`` and ``count(DISTINCT ..)``: null keys are a group, null values are not counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources import manifest
from riskweave.sources.readers import FREED, options
from riskweave.sources.sinks import BATCH, append_once, read_batches


@dataclass(frozen=True)
class Rollup:
    """Group keys, and measures by name: ``sums``, ``lows`` and ``highs`` are expressions of a row, ``distinct``
    names expressions whose values are counted once per group. A sum over rows is exact for integers
    and decimals; of doubles it depends on the batches as any sum depends on its order."""

    keys: tuple[str, ...]
    sums: Mapping[str, str] = field(default_factory=dict)
    lows: Mapping[str, str] = field(default_factory=dict)
    highs: Mapping[str, str] = field(default_factory=dict)
    distinct: Mapping[str, str] = field(default_factory=dict)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]):
    """Equality of columns in which null equals null, as in a grouping."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def _broadcasts(df: DataFrame) -> bool:
    """Whether Spark, by its estimate of the size, hands the frame to every task of a join."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def _stored(df: DataFrame, path: str) -> DataFrame:
    """The frame written and read back, so that Spark knows its size."""
    with options(df.sparkSession, FREED):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _new_values(rows: DataFrame, rollup: Rollup, name: str, path: str, batch_id: str) -> DataFrame:
    """Values of a batch that no earlier batch has shown in their group, stored under the batch's name.

    The batch's values are written first, so Spark knows their size: below its broadcast limit every task gets
    them and the stored values are filtered where they are scanned, without a shuffle. Of a larger batch
    hashes are compared first; stored values move only where their hash comes again, and are then compared as they are.
    """
    spark, columns, done = rows.sparkSession, [*rollup.keys, "value"], f"{path}/{BATCH}={batch_id}"
    values = rows.selectExpr(*[f"`{k}`" for k in rollup.keys], f"{rollup.distinct[name]} AS value")
    values = values.where("value IS NOT NULL").distinct()
    if not manifest.finished(spark, done):
        shown, again, seen = (f"{path}/_{part}-{batch_id}" for part in ("shown", "again", "seen"))
        fresh = batch = _stored(values, shown)
        try:
            stored = read_batches(spark, path, but=[batch_id]).select(*columns)
            if _broadcasts(batch):
                held = stored.join(batch, _same(stored, batch, columns), "left_semi")
            else:
                hashed = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_hash")
                common = _stored(stored.select(hashed).join(batch.select(hashed), "_hash", "left_semi").distinct(), again)
                held = _stored(stored.select("*", hashed).join(common, "_hash", "left_semi").drop("_hash"), seen)
            fresh = batch.join(held, _same(batch, held, columns), "left_anti")
        except FileNotFoundError:
            pass
        append_once(fresh, path, batch_id)
        for part in (shown, again, seen):
            manifest.delete(spark, part)
    return spark.read.schema(values.schema).parquet(done)


def add_batch(rows: DataFrame, rollup: Rollup, root: str, batch_id: str) -> bool:
    """Add the rows of a named batch; whether the batch was new. Sent again, it changes nothing; a batch that did
    not end goes on where it stopped. Rows belong to one batch only, such as the rows of
    a day after deduplication, or those that came late for it. One writer at a time.

    Rows and new values are folded in one grouping, to which each gives its own measures and null for the others.
    """
    spark, parts = rows.sparkSession, f"{root}/partials"
    if manifest.finished(spark, f"{parts}/{BATCH}={batch_id}"):
        return False
    keys, one, none = [F.col(f"`{k}`") for k in rollup.keys], F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    inputs = {**rollup.sums, **rollup.lows, **rollup.highs}
    folded = rows.select(
        *keys, one.alias("_rows"), *[F.expr(e).alias(n) for n, e in inputs.items()], *[none.alias(n) for n in rollup.distinct]
    )
    types = {f.name: f.dataType for f in folded.schema}
    for name in rollup.distinct:
        new = _new_values(rows, rollup, name, f"{root}/values_{name}", batch_id)
        absent = [F.lit(None).cast(types[n]).alias(n) for n in inputs]
        counted = [(one if n == name else none).alias(n) for n in rollup.distinct]
        folded = folded.union(new.select(*keys, none.alias("_rows"), *absent, *counted))
    measures = [F.sum(n).alias(n) for n in ("_rows", *rollup.sums)]
    measures += [F.min(n).alias(n) for n in rollup.lows] + [F.max(n).alias(n) for n in rollup.highs]
    partial = folded.groupBy(*keys).agg(*measures, *[F.sum(n).alias(n) for n in rollup.distinct])
    return append_once(partial, parts, batch_id)


def merged(spark: SparkSession, rollup: Rollup, root: str) -> DataFrame:
    """One row per group over all batches: the keys and the measures under their names."""
    measures = [F.sum(n).alias(n) for n in (*rollup.sums, *rollup.distinct)]
    measures += [F.min(n).alias(n) for n in rollup.lows] + [F.max(n).alias(n) for n in rollup.highs]
    return read_batches(spark, f"{root}/partials").groupBy(*[F.col(f"`{k}`") for k in rollup.keys]).agg(*measures)
