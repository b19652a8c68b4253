"""Current state from a change stream (type 1)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.latest import current_state, latest_changes
from riskweave.sources import manifest
from riskweave.sources.readers import kept

_BUCKET = "_bucket"


def newest_per_key_stream(
    df: DataFrame, keys: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """Newest change per key, held in the state store; run in update or complete mode.

    Deletes stay in the state so that an older change that arrives later cannot bring
    the key back; ``current_from`` removes them on read.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*sequence)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, "row.*")


def current_from(
    newest: DataFrame, delete_when: str, drop_cols: Sequence[str]
) -> DataFrame:
    return newest.filter(f"NOT coalesce({delete_when}, false)").drop(*drop_cols)


def fold_changes(
    path: str, keys: Sequence[str], sequence: Sequence[str]
) -> Callable[[DataFrame, int], None]:
    """Batch handler that stores the newest change per key of each micro-batch.

    A batch writes to a folder named by its id, so a repeated batch replaces itself. The
    work of a batch grows with the batch and not with the number of keys held.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest_changes(batch, keys, sequence).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return handle


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folded batches."""
    found = [int(n.partition("=")[2]) for n in manifest.names(spark, path) if n.startswith("batch_id=")]
    return [n for n in sorted(found) if manifest.finished(spark, f"{path}/batch_id={n}")]


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest manifest of the merged state: ``upto``, the last batch in it, ``buckets``, their folders,
    their number and the schema."""
    return manifest.current(spark, f"{path}_state") or (0, {"upto": -1, "buckets": {}, "count": None, "schema": None})


def _folders(spark: SparkSession, path: str, held: dict, wanted: Iterable[str]) -> DataFrame | None:
    places = [f"{path}_state/{held['buckets'][b]}" for b in wanted if b in held["buckets"]]
    return spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(*places) if places else None


def _pending(spark: SparkSession, path: str, upto: int) -> DataFrame | None:
    later = [f"{path}/batch_id={n}" for n in _batches(spark, path) if n > upto]
    return spark.read.parquet(*later) if later else None


def compact_changes(
    spark: SparkSession, path: str, keys: Sequence[str], sequence: Sequence[str], buckets: int = 64, keep: int = 2
) -> bool:
    """Merge the batches folded since the last time into the state, which lies in ``buckets`` folders by
    a hash of the key. Only the buckets that the batches touch are written anew, beside the old
    ones; a manifest written last makes the change, then the batches go, and so do buckets that none of the
    last ``keep`` manifests names. Deletes are kept, because they still outrank older changes
    that may arrive. Run it between batches. False when no batch has ever come.

    The number of buckets is that of the first run. A batch of few keys rewrites few buckets, so
    choose it such that a bucket is some hundred MB.
    """
    number, held = _state(spark, path)
    # What a merge that ended left behind, in case its clean-up did not.
    for n in _batches(spark, path):
        if n <= held["upto"]:
            manifest.delete(spark, f"{path}/batch_id={n}")
    pending = _pending(spark, path, held["upto"])
    if pending is None:
        return bool(held["buckets"])
    upto, count = _batches(spark, path)[-1], held["count"] or buckets
    bucket = F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {count}) AS int)")
    changes = kept(latest_changes(pending, keys, sequence).withColumn(_BUCKET, bucket))
    touched = sorted(str(r[0]) for r in changes.select(_BUCKET).distinct().collect())
    rows, before = changes, _folders(spark, path, held, touched)
    if before is not None:
        rows = rows.unionByName(before.withColumn(_BUCKET, bucket))
    newest = latest_changes(rows, [_BUCKET, *keys], sequence)
    # One shuffle: the bucket is part of the key that ranks, and files are cut by bucket.
    folder = f"merge={number + 1}-{os.urandom(4).hex()}"
    newest.repartition(count, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}_state/{folder}")
    places = {**held["buckets"], **{b: f"{folder}/{_BUCKET}={b}" for b in touched}}
    schema = newest.drop(_BUCKET).schema.jsonValue()
    manifest.commit(spark, f"{path}_state", {"upto": upto, "buckets": places, "count": count, "schema": schema}, number)
    for n in _batches(spark, path):
        if n <= upto:
            manifest.delete(spark, f"{path}/batch_id={n}")
    used = {p for e in manifest.retired(spark, f"{path}_state", keep) for p in e["buckets"].values()}
    for merge in manifest.names(spark, f"{path}_state"):
        if merge.startswith("merge=") and manifest.finished(spark, f"{path}_state/{merge}"):
            own = [n for n in manifest.names(spark, f"{path}_state/{merge}") if n.startswith(f"{_BUCKET}=")]
            for name in own:
                if f"{merge}/{name}" not in used:
                    manifest.delete(spark, f"{path}_state/{merge}/{name}")
            if not any(p.startswith(f"{merge}/") for p in used):
                manifest.delete(spark, f"{path}_state/{merge}")
    return True


def folded_state(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    sequence: Sequence[str],
    delete_when: str,
    drop_cols: Sequence[str],
) -> DataFrame:
    """Current rows over all folded batches. Arrival order does not matter."""
    _, held = _state(spark, path)
    merged, pending = _folders(spark, path, held, sorted(held["buckets"])), _pending(spark, path, held["upto"])
    if merged is None and pending is None:
        raise FileNotFoundError(f"no finished batch under {path}")
    changes = pending if merged is None else merged if pending is None else merged.unionByName(pending)
    return current_state(changes, keys, sequence, delete_when, drop_cols)
