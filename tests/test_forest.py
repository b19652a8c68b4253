"""Exact medians, and a forest's node table beside the model it comes from."""

import math
import random
import statistics

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import forest
from riskweave.operators import model as mdl
from riskweave.operators.median import exact_medians


def _medians(spark, columns, buckets):
    names = list(columns)
    rows = list(zip(*columns.values()))
    return exact_medians(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), names, buckets)


def test_medians_of_ties_gaps_and_extremes(spark):
    dice = random.Random(3)
    columns = {
        "even": [float(i) for i in range(100)],
        "ties": [7.0] * 60 + [float(i) for i in range(40)],
        "skewed": [10.0 ** dice.uniform(-200, 200) for _ in range(100)],
        "wide": [dice.choice([-1, 1]) * 1.7e308 * dice.random() for _ in range(100)],
        "two": [1.0, 2.0] * 50,
        "one": [5.5] * 100,
    }
    expected = {c: sum(sorted(v)[49:51][k] / 2 for k in (0, 1)) for c, v in columns.items()}
    for buckets in (3, 1000):
        got = _medians(spark, columns, buckets)
        assert all(math.isclose(got[c], expected[c], rel_tol=1e-15) for c in columns), (buckets, got)


def test_medians_of_nulls_nan_infinity_and_nothing(spark):
    columns = {
        "nulls": [None, 3.0, 1.0, math.nan, 2.0],
        "ends": [-math.inf, math.inf, 4.0, 5.0, 9.0],
        "empty": [None, math.nan, None, None, None],
        "odd": [5.0, 1.0, 4.0, 2.0, 3.0],
    }
    assert _medians(spark, columns, 10) == {"nulls": 2.0, "ends": 5.0, "empty": None, "odd": 3.0}
    none = spark.createDataFrame([], "a double")
    assert exact_medians(none, ["a"]) == {"a": None}


def _rows(spark, n):
    dice = random.Random(11)
    rows = []
    for i in range(n):
        fraud = dice.random() < 0.3
        numbers = [dice.gauss(400.0 if fraud else 100.0, 80.0) if k == 0 else float(dice.randrange(4 if fraud else 2)) for k in range(len(mdl.NUMERIC_FEATURES))]
        if i % 17 == 0:
            numbers[0] = None
        words = [dice.choice("abc" if fraud else "bcd") for _ in mdl.CATEGORICAL_FEATURES]
        rows.append((f"e{i}", int(fraud), *numbers, *words))
    kinds = ", ".join([*(f"{c} double" for c in mdl.NUMERIC_FEATURES), *(f"{c} string" for c in mdl.CATEGORICAL_FEATURES)])
    return spark.createDataFrame(rows, f"event_id string, label int, {kinds}")


def test_descent_equals_the_model(spark):
    train = _rows(spark, 600)
    model = mdl.fit(train, trees=7, depth=5)
    nodes = forest.node_table(spark, model)
    kinds = nodes.agg(F.count("threshold").alias("t"), F.count("left_categories").alias("c"), F.count("leaf_value").alias("v")).first()
    assert min(kinds) > 0
    out = model.transform(mdl.as_double(train))
    both = forest.descend(out, nodes, 5, "q").select(vector_to_array("probability")[1].alias("p"), "q", "label").collect()
    assert len(both) == 600 and all(abs(r["p"] - r["q"]) <= 1e-9 for r in both)
    # It learnt something: a constant would not part the classes.
    mean = {k: statistics.mean(r["q"] for r in both if r["label"] == k) for k in (0, 1)}
    assert mean[1] - mean[0] > 0.4
    fill = exact_medians(train, ["amount"])["amount"] if "amount" in mdl.NUMERIC_FEATURES else None
    if fill is not None:
        filled = out.where("event_id = 'e0'").first()
        assert filled["amount"] is None and filled["amount_filled"] == fill
    with pytest.raises(ValueError, match="nodes"):
        forest.descend(out, nodes, 5, most_nodes=3)


def test_descent_of_bare_leaves_and_inputs_without_a_number(spark):
    kinds = "tree int, node int, feature int, threshold double, left_categories array<double>, left_node int, right_node int, leaf_value double"
    rows = [(0, 0, None, None, None, None, None, 0.25), (1, 0, 1, 2.0, None, 1, 2, None), (1, 2, None, None, None, None, None, 1.0), (1, 1, None, None, None, None, None, 0.5)]
    inputs = spark.createDataFrame([(0, [9.0, 2.0]), (1, [9.0, 2.5]), (2, [9.0, math.nan])], "id int, x array<double>")
    frame = inputs.select("id", array_to_vector("x").alias("features"))
    for more, alone in ([], True), ([(2, 0, 1, None, [2.5], 1, 2, None), (2, 1, None, None, None, None, None, 0.0), (2, 2, None, None, None, None, None, 1.0)], False):
        nodes = spark.createDataFrame(rows + more, kinds)
        out = {r["id"]: r["q"] for r in forest.descend(frame, nodes, 3, "q").collect()}
        ordered = {0: 0.75, 1: 1.25, 2: 1.25}
        assert out == ({k: v / 2 for k, v in ordered.items()} if alone else {0: 1.75 / 3, 1: 1.25 / 3, 2: 2.25 / 3})


def test_a_feature_without_numbers_is_refused(spark):
    train = _rows(spark, 60).withColumn(mdl.NUMERIC_FEATURES[1], F.lit(None).cast("double"))
    with pytest.raises(ValueError, match=mdl.NUMERIC_FEATURES[1]):
        mdl.fit(train, trees=2)


def test_votes_equal_the_model_to_the_last_bit(spark):
    train = _rows(spark, 600)
    model = mdl.fit(train, trees=9, depth=6)
    out = model.transform(mdl.as_double(train)).select("event_id", vector_to_array("probability")[1].alias("p"))
    got = mdl.predict(model, train)
    assert got.columns == [*train.columns, "fraud_probability", "ml_prediction"]
    both = got.join(out, "event_id").select("p", "fraud_probability").collect()
    assert len(both) == 600 and all(p == q for p, q in both) and len(set(both)) > 20
    assert mdl.predict(model, train.where("false")).count() == 0


def test_votes_of_bare_leaves_sets_and_inputs_without_a_number(spark):
    kinds = "tree int, node int, feature int, threshold double, left_categories array<double>, left_node int, right_node int, leaf_value double, leaf_rest double"
    split, leaf = (None, None, None, None, None), (None, None)
    rows = [(0, 0, *split, 0.25, 0.75), (1, 0, 1, 2.0, None, 1, 2, *leaf), (1, 2, *split, 1.0, 0.0), (1, 1, *split, 0.5, 0.5)]
    sets = [(2, 0, 1, None, [2.5, 7.0], 1, 2, *leaf), (2, 1, *split, 0.0, 1.0), (2, 2, *split, 1.0, 0.0)]
    inputs = spark.createDataFrame([(0, [9.0, 2.0]), (1, [9.0, 2.5]), (2, [9.0, math.nan])], "id int, x array<double>")
    frame = inputs.select("id", array_to_vector("x").alias("features"))
    ordered = {0: 0.75, 1: 1.25, 2: 1.25}
    for more, expected in ([], {k: v / 2 for k, v in ordered.items()}), (sets, {0: 1.75 / 3, 1: 1.25 / 3, 2: 2.25 / 3}):
        out = frame.select("id", forest.vote(spark.createDataFrame(rows + more, kinds), F.col("features")).alias("q")).collect()
        assert {r["id"]: r["q"] for r in out} == expected


def test_scoring_plan_walks_the_forest_once_and_not_by_row(spark):
    train = _rows(spark, 200)
    plan = mdl.ml_actions(mdl.predict(mdl.fit(train, trees=3, depth=3), train))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "predictRaw" not in plan and "RandomForest" not in plan
