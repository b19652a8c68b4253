"""The projection forest against all cosines."""

import numpy as np
import pytest

from riskweave.llm import rpforest

VECTORS = "vec_id long, embedding array<float>, label int"


def _brute(rows, least=0.93):
    fine = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        x = np.array(v, dtype=np.float64)
        fine[i] = (label, x / np.linalg.norm(x))
    links = {i: [j for j in fine if j != i and fine[j][0] == fine[i][0] and len(fine[j][1]) == len(fine[i][1]) and fine[i][1] @ fine[j][1] >= least] for i in fine}
    component = {}
    for i in sorted(links):
        todo = [i] if i not in component else []
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += links[j]
    return {(i, len(links.get(i, [])), component.get(i, i)) for i, _, _ in rows}


def _rows():
    rng = np.random.default_rng(3)
    rows, number = [], 0
    for label in range(3):
        for _ in range(40):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((number, (centre + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), label))
                number += 1
    centre = rng.normal(size=16)
    near = [(5000 + i, (centre + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), 1) for i in range(150)]
    copies = [(6000 + i, rows[0][1], 0) for i in range(100)]
    odd = [(7000, None, 1), (7001, [0.0] * 16, 1), (7002, [1.0] * 15 + [None], 1), (7003, [float("nan")] * 16, 1), (7004, [1.0] * 16, None), (7005, [1e38] * 16, 1), (7006, [1.0] * 16, 1), (7007, [1.0] * 3, 1)]
    return rows + near + copies + odd


@pytest.mark.parametrize("leaf", [512, 40])
def test_all_cosines(spark, leaf):
    rows = _rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(4).selectExpr("*", "1 AS id", "2 AS leaf", "3 AS links")
    out = rpforest.near_vectors(df, rpforest.Forest(leaf=leaf))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, expected = {tuple(r)[:3] for r in out.collect()}, _brute(rows)
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in expected)
    most = {r[0]: r[1] for r in expected}
    assert all(r[1] <= most[r[0]] for r in got)
    if leaf == 512:
        assert got == expected
    else:
        assert found >= 0.98 * all_links
    assert len(got) == len(rows)


def test_recall_of_split_cells(spark):
    """Pairs near the limit, in cells that are split several times."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        a, b = rng.normal(size=32), rng.normal(size=32)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.astype(np.float32).tolist(), 0), (2 * i + 1, (0.935 * a + np.sqrt(1 - 0.935**2) * b).astype(np.float32).tolist(), 0)]
    out = rpforest.near_vectors(spark.createDataFrame(rows, VECTORS), rpforest.Forest(leaf=200))
    assert sum(r["n_links"] for r in out.collect()) >= 0.95 * 3000


def test_empty(spark):
    assert rpforest.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_repeated_ids(spark):
    """A repeated row is one vector; an id with two vectors is two, and the smallest id of all names the component."""
    a, b, c = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0), (1, a, 0), (2, b, 0), (3, c, 0), (2, c, 0), (9, c, 0), (0, b, 1)]
    out = rpforest.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(tuple(r)[:3] for r in out) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 2, 2), (2, 2, 2), (9, 2, 2), (0, 0, 0)])
