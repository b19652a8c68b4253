"""Clusters against plain rounds over all vectors."""

import hashlib
import random

import numpy as np
import pytest

from riskweave.llm import heapmeans

VECTORS = "vec_id long, embedding array<double>"


def _brute(rows, at):
    fine = [(i, [int(np.floor(at.scale * e)) for e in v]) for i, v in rows if v is not None and len(v) == at.dims and all(e is not None and np.isfinite(e) for e in v)]
    code = lambda i: (i is None, hashlib.sha256(f"{at.salt}{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(fine, key=lambda r: (code(r[0]), r[1]))[: at.clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(at.rounds):
        own = [nearest(v) for _, v in fine]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(fine, own) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    own = [nearest(v) for _, v in fine]
    d = [far(v, centroids[o]) for (_, v), o in zip(fine, own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        [(i, o, x, sum(e for e, p in zip(d, own) if p == o), sum(d), digest[o]) for (i, _), o, x in zip(fine, own, d)], key=repr
    )


def _rows(dims=5, size=1.0):
    rng = random.Random(11)
    centres = [[rng.uniform(-size, size) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.1 * size) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, [float(rng.randrange(-1, 2)) * size for _ in range(dims)]) for i in range(200)]  # many ties
    rows += [(2000 + i, [0.5 * size] * dims) for i in range(150)]  # one vector many times
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, [0.25] * dims), (3000, None), (3001, []), (3002, [1.0] * (dims - 1))]
    return rows + [(3003, [None] + [1.0] * (dims - 1)), (3004, [float("nan")] * dims), (3005, [float("inf")] * dims)]


@pytest.mark.parametrize("size", [1.0, 3e5])
def test_plain_rounds(spark, size):
    """Whole numbers that floating point holds exactly, and larger ones."""
    at = heapmeans.Settings(clusters=6, rounds=4, dims=5, rows=97)
    rows = _rows(size=size)
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", "1 AS x", "'l' AS own", "2 AS cluster", "3 AS ids")
    out = heapmeans.clustered(vectors, at)
    assert sorted(map(tuple, out.collect()), key=repr) == _brute(rows, at)


def test_most_vectors_are_not_looked_at_again(spark):
    rng = random.Random(2)
    centres = [[rng.uniform(-9, 9) for _ in range(5)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 16]]) for i in range(4000)]
    at = heapmeans.Settings(clusters=16, rounds=6, dims=5)
    found = heapmeans.fit(heapmeans.kept(spark.createDataFrame(rows, VECTORS), at), at)
    assert found.looks[0] == 4000 and found.looks[-1] < 400 and sum(found.looks[1:]) < 4000 * 5


def test_expired_vectors_alone_are_popped():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (500, 4))
    centroids = rng.integers(-50, 50, (5, 4))
    block = heapmeans.Block.of(x, centroids)
    own, gap = heapmeans.looked_at(x, centroids)
    drift = np.array([3.0, 0.0, 9.0, 1.0, 5.0])
    stored = heapmeans.Block.read(block.row(list(range(500)), {}), 0, 4)
    assert stored.expired(drift).tolist() == np.flatnonzero(gap <= drift[own]).tolist()
    assert sum(len(h[0]) if isinstance(h, tuple) else len(h) for h in stored.heaps) == (gap > drift[own]).sum()


def test_few_and_none(spark):
    at = heapmeans.Settings(clusters=4, dims=2)
    assert heapmeans.clustered(spark.createDataFrame([], VECTORS), at).collect() == []
    rows = [(1, [0.5, 0.5]), (2, [-0.5, 0.1])]
    assert sorted(map(tuple, heapmeans.clustered(spark.createDataFrame(rows, VECTORS), at).collect())) == _brute(rows, at)
    assert sorted(map(tuple, heapmeans.clustered(spark.createDataFrame(rows[:1], VECTORS), at).collect())) == _brute(rows[:1], at)
