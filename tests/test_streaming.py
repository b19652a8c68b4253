"""Streams over files: duplicates, late rows, out-of-order changes, restarts."""

import datetime as dt

import pytest

from riskweave.functions.conform import conform
from riskweave.operators import expectations as exp
from riskweave.operators.latest import CUSTOMER_SEQUENCE, current_customers
from riskweave.sources import feeds
from riskweave.sources.readers import accepted_stream, accepted_table, quarantine_table, stream
from riskweave.streaming.cdc import compact_changes, current_from, fold_changes, folded_state, newest_per_key_stream
from riskweave.streaming.dedup import dedup_stream
from riskweave.streaming.ingest import land_stream, run_available, run_batches

T0 = dt.datetime(2026, 1, 1)
EVENT = "event_id string, event_timestamp timestamp, v int"


class Landing:
    """A folder that receives files, and the stream over it."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.path = spark, str(folder)
        self.schema = spark.createDataFrame([], ddl).schema

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, **options):
        return stream(self.spark, self.path, self.schema, **options)


@pytest.mark.parametrize("splits", [0, 4])
def test_duplicates_in_same_and_later_batch(spark, tmp_path, splits):
    land, out, log = Landing(spark, tmp_path / "in", EVENT), str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: run_available(dedup_stream(land.read(), "event_id", "event_timestamp", splits=splits), out, log)
    land.add(("a", T0, 1), ("a", T0, 1), ("b", T0, 2))
    run()
    land.add(("a", T0, 3), ("c", T0, 4))
    run()  # continues from the checkpoint
    run()  # nothing new
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(out).filter("event_id = 'a'").first()["v"] == 1


@pytest.mark.parametrize("splits", [0, 4])
def test_hot_record_in_one_batch(spark, tmp_path, splits):
    """Copies of one record in every file of a batch."""
    land, out = Landing(spark, tmp_path / "in", EVENT), str(tmp_path / "out")
    for i in range(6):
        land.add(*[("hot", T0, i) for _ in range(50)], (f"e{i}", T0, i))
    stream_ = dedup_stream(land.read(), "event_id", "event_timestamp", splits=splits)
    run_available(stream_, out, str(tmp_path / "log"))
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [f"e{i}" for i in range(6)] + ["hot"]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    land, out, log = Landing(spark, tmp_path / "in", EVENT), str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: run_available(dedup_stream(land.read(), "event_id", "event_timestamp"), out, log)
    land.add(("a", T0 + dt.timedelta(days=10), 1))
    run()
    land.add(("late", T0, 2), ("in_time", T0 + dt.timedelta(days=9, hours=12), 3))
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "in_time"]


def test_old_rows_of_a_backfill_are_kept(spark, tmp_path):
    """One triggered batch over many files: the watermark moves only afterwards."""
    land, out = Landing(spark, tmp_path / "in", EVENT), str(tmp_path / "out")
    for day in (30, 0, 15):
        land.add((f"d{day}", T0 + dt.timedelta(days=day), day))
    run_available(dedup_stream(land.read(), "event_id", "event_timestamp"), out, str(tmp_path / "log"))
    assert spark.read.parquet(out).count() == 3


def _change(i, op, seq, segment="LOW", who="c1"):
    return (f"chg{i:03d}", T0 + dt.timedelta(minutes=i), op, who, segment, "CA", "e", None, seq, True)


BATCHES = [
    [_change(1, "INSERT", 1), _change(2, "INSERT", 1, who="c2"), _change(3, "UPDATE", 9, "HIGH", "c3")],
    [_change(4, "DELETE", 7), _change(5, "UPDATE", 3, "MEDIUM", "c2"), _change(6, "INSERT", 1, who="c3")],
    [_change(7, "UPDATE", 5, "HIGH"), _change(8, "UPDATE", 2, None, "c2"), _change(9, "UPDATE", 4, who="c4")],
]
DELETE, DROP = "operation = 'DELETE'", ["operation", "change_id"]


def _rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_folded_changes_equal_batch(spark, tmp_path, order):
    land, path = Landing(spark, tmp_path / "in", feeds.CUSTOMER_CHANGE.schema), str(tmp_path / "state")
    for i in order:  # a new query over the same checkpoint each time
        land.add(*BATCHES[i])
        run_batches(land.read(), fold_changes(path, ["customer_id"], CUSTOMER_SEQUENCE), str(tmp_path / "log"))
    state = folded_state(spark, path, ["customer_id"], CUSTOMER_SEQUENCE, DELETE, DROP)
    expected = current_customers(spark.read.parquet(land.path))
    assert _rows(state.select(*expected.columns)) == _rows(expected)
    assert sorted((r["customer_id"], r["risk_segment"]) for r in state.collect()) == [("c2", "MEDIUM"), ("c3", "HIGH"), ("c4", "LOW")]


def test_compaction_keeps_the_state_and_its_deletes(spark, tmp_path):
    path, key = str(tmp_path / "state"), ["customer_id"]
    handle = fold_changes(path, key, CUSTOMER_SEQUENCE)
    frames = [spark.createDataFrame(rows, feeds.CUSTOMER_CHANGE.schema) for rows in BATCHES]
    state = lambda: folded_state(spark, path, key, CUSTOMER_SEQUENCE, DELETE, DROP)
    for i, df in enumerate(frames[:2]):
        handle(df, i)
    before = _rows(state())
    compact_changes(spark, path, key, CUSTOMER_SEQUENCE)
    assert _rows(state()) == before
    handle(frames[2], 2)  # holds a change of c1 that is older than its delete
    expected = current_customers(frames[0].union(frames[1]).union(frames[2]))
    assert _rows(state().select(*expected.columns)) == _rows(expected)
    compact_changes(spark, path, key, CUSTOMER_SEQUENCE)
    assert _rows(state().select(*expected.columns)) == _rows(expected)


def test_repeated_batch_replaces_itself(spark, tmp_path):
    df, path = spark.createDataFrame(BATCHES[0], feeds.CUSTOMER_CHANGE.schema), str(tmp_path / "state")
    handle = fold_changes(path, ["customer_id"], CUSTOMER_SEQUENCE)
    handle(df, 0)
    handle(df, 0)
    assert spark.read.parquet(path).count() == 3


def test_stateful_changes_equal_batch(spark, tmp_path):
    land = Landing(spark, tmp_path / "in", feeds.CUSTOMER_CHANGE.schema)
    for i, rows in enumerate(BATCHES):
        land.add(*rows)
        query = (
            newest_per_key_stream(land.read(), ["customer_id"], CUSTOMER_SEQUENCE)
            .writeStream.format("memory").queryName(f"newest_{i}").outputMode("complete")
            .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    state = current_from(spark.table(f"newest_{len(BATCHES) - 1}"), DELETE, DROP)
    expected = current_customers(spark.read.parquet(land.path))
    assert _rows(state.select(*expected.columns)) == _rows(expected)


def test_landing_stream_splits_and_counts(spark, tmp_path):
    feed = feeds.CUSTOMER_CHANGE
    land, path = Landing(spark, tmp_path / "in", feed.schema), str(tmp_path / "bronze")
    bad = _change(10, "MERGE", None)
    for rows in (BATCHES[0] + [bad], BATCHES[1]):
        land.add(*rows)
        land_stream(land.read(), feed, feed.name, path, str(tmp_path / "log"))
    assert accepted_table(spark, path).count() == 6
    held = quarantine_table(spark, path).collect()
    assert [r[exp.REASONS] for r in held] == ["customer_operation_supported,customer_sequence_positive"]
    batch = exp.accepted(conform(spark.read.parquet(land.path), feed, feed.name), feed.rules)
    assert _rows(accepted_table(spark, path).drop("_ingested_at")) == _rows(batch.drop("_ingested_at"))
    out = str(tmp_path / "again")
    run_available(accepted_stream(spark, path, feed), out, str(tmp_path / "log2"))
    assert spark.read.parquet(out).count() == 6


def test_guard_stops_a_stream(spark, tmp_path):
    land = Landing(spark, tmp_path / "in", EVENT)
    land.add((None, T0, 1))
    with pytest.raises(Exception, match="id_present"):
        run_available(exp.require(land.read(), {"id_present": "event_id IS NOT NULL"}), str(tmp_path / "out"), str(tmp_path / "log"))
