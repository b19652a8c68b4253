"""Layers that are stored on the way: what stays on disk, and that the result is that of one plan."""

import glob
import inspect
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import test_forest
from riskweave.operators import decisions as dec
from riskweave.operators import model as mdl
from riskweave.plans import layers as lay
from riskweave.plans import queries
from riskweave.sources import readers, sinks

SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")
# Run times.
TIMES = {"decisioned_at", "scored_at"}


def _shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(f) for f in (place.toString() for place in store.localDirs()) for f in glob.glob(f"{f}/**/shuffle_*", recursive=True)}


def _shared(spark):
    return set(glob.glob(readers.shared_folder(spark).removeprefix("file:") + "/kept-*"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled(spark):
    return spark.range(0, 500, 1, 3).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()


@pytest.mark.parametrize("write", ["kept", "write_version", "append_once"])
def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path, write):
    before = _shuffle_files(spark)
    if write == "kept":
        rows = readers.kept(_shuffled(spark))
    elif write == "write_version":
        sinks.write_version(_shuffled(spark), str(tmp_path / "t"), "1")
        rows = sinks.read_version(spark, str(tmp_path / "t"))
    else:
        sinks.append_once(_shuffled(spark), str(tmp_path / "t"), "a")
        rows = sinks.read_batches(spark, str(tmp_path / "t"))
    assert not _shuffle_files(spark) - before
    assert sorted(r["count"] for r in rows.collect()) == [71] * 4 + [72] * 3


def test_kept_times_are_exact_and_session_options_come_back(spark):
    names = [*readers.FREED, *readers.OWN_TABLE]
    before = [spark.conf.get(n, None) for n in names]
    times = ["0001-01-01 00:00:00.000001", "1850-06-01 12:00:00", "2026-01-01 01:02:03.456789", "9999-12-31 23:59:59.999999"]
    rows = spark.createDataFrame([(t,) for t in times] + [(None,)], "t string").selectExpr("timestamp(t) AS t")
    assert sorted(map(str, [r[0] for r in readers.kept(rows).selectExpr("unix_micros(t)").collect()])) == sorted(
        map(str, [r[0] for r in rows.selectExpr("unix_micros(t)").collect()])
    )
    assert [spark.conf.get(n, None) for n in names] == before


def test_discard_deletes_kept_tables_alone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "source"))
    source, stored = spark.read.parquet(str(tmp_path / "source")), readers.kept(spark.range(5))
    out = readers.kept(source.join(stored, "id"))
    readers.discard(source.join(stored, "id"))
    assert source.count() == 3 and out.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        stored.count()


@pytest.mark.parametrize("name, lazy", [("d18_decisions", "decisions"), ("j5_m12_compared", "compared")])
def test_stored_layers_give_the_rows_of_one_plan(spark, name, lazy):
    one = queries.comparable(getattr(lay, lazy)(spark, SF).drop(*TIMES))
    got = queries.queries()[name](spark, SF).drop(*TIMES)
    assert got.columns == one.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)


@pytest.mark.parametrize("name", ["d18_decisions", "j5_m12_compared", "o1_ordered_report", "g2_protected_view"])
def test_the_last_plan_neither_joins_orders_nor_deduplicates(spark, name):
    plan = _plan(queries.queries()[name](spark, SF))
    assert "lineitem" not in plan and "events.parquet" not in plan and "WindowGroupLimit" not in plan


@pytest.mark.parametrize("name, stays", [("k5_reopened_view", 0), ("h_health", 1), ("a6_metrics_by_batch", 1)])
def test_stored_layers_go_when_their_result_is_stored(spark, name, stays):
    before, files = _shared(spark), _shuffle_files(spark)
    out = queries.queries()[name](spark, SF)
    assert len(_shared(spark) - before) == stays and not _shuffle_files(spark) - files
    assert out.count() > 0


def test_daily_metrics_store_no_more_of_a_decision_than_they_read(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(queries, "kept", lambda rows: stored.append(rows.columns) or readers.kept(rows))
    queries.queries()["a6_metrics_by_batch"](spark, SF)
    assert stored == [list(dec.METRICS_INPUTS)]


@pytest.mark.parametrize("name", ["m6_descent", "m9_model_scoring"])
def test_a_model_is_fitted_over_one_stored_table(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def stop(train, *rest, **more):
        raise Seen

    before, files = _shared(spark), _shuffle_files(spark)
    monkeypatch.setattr(mdl, "fit", stop)
    monkeypatch.setattr(mdl, "check_classes", lambda frame: None)
    with pytest.raises(Seen):
        queries.queries()[name](spark, SF)
    assert len(_shared(spark) - before) == 1 and not _shuffle_files(spark) - files


def test_every_tree_is_grown_from_all_rows(spark, monkeypatch, tmp_path):
    """Trees grown in groups are one forest, which can be stored; no group sees a part of the rows."""
    assert "most_rows" not in inspect.signature(mdl.fit).parameters and not hasattr(mdl, "training_sample")
    train, seen, fit = test_forest._rows(spark, 300), [], mdl.RandomForestClassifier.fit

    def spied(self, inputs, *rest):
        seen.append((self.getNumTrees(), inputs.count(), self.getSeed()))
        return fit(self, inputs, *rest)

    monkeypatch.setattr(mdl.RandomForestClassifier, "fit", spied)
    before = _shared(spark)
    model = mdl.fit(train, trees=20, depth=4, most_counts=300 * 9)
    assert [n for n, _, _ in seen] == [6, 7, 7] and {rows for _, rows, _ in seen} == {300} and len({s for *_, s in seen}) == 3
    assert model.stages[-1].getNumTrees == 20 and _shared(spark) == before
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(mdl.as_double(train)).select("event_id", vector_to_array("probability")[1].alias("p"))
    both = mdl.predict(model, train).join(again, "event_id").select("p", "fraud_probability").collect()
    assert len(both) == 300 and all(p == q for p, q in both) and len(set(both)) > 20
