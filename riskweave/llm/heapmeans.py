"""Centroid clustering in rounds, where heaps of bounds tell which vectors need a look.

A vector that is looked at gets the distance u to its own centroid and l to the second nearest. Its
assignment cannot change before the centroids have moved so far that the gap l - u is used up: a
round uses at most the own centroid's shift plus the greatest shift of the others. Each cluster
adds these up (its drift) and keeps a heap of gap + drift at the time of the look. What is at the top
and not above the drift has expired: it is popped and compared with all centroids again. The
rest of the cluster is not touched.

Vectors lie in blocks, one row each: an Arrow batch of the table, so nothing is shuffled. Each
round writes the blocks anew with their heaps. What vectors that changed their cluster add to and
take from sums and counts is added up by Spark; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import discard, stored


@dataclass(frozen=True)
class Settings:
    """clusters, rounds: centroids and times that they move; dims: components of a vector; scale: what
    components are multiplied by before they are rounded down; salt: start of the text whose hash
    chooses the first centroids; rows: vectors of a block at most."""

    clusters: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    salt: str = "1:"
    rows: int = 8192


def kept(vectors: DataFrame, at: Settings = Settings()) -> DataFrame:
    """``vec_id`` and ``x``, whole numbers, of the vectors that take part."""
    fine = (
        f"embedding IS NOT NULL AND size(embedding) = {at.dims} AND "
        "forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(double(v)) < double('Infinity'))"
    )
    return vectors.where(fine).selectExpr(
        "cast(vec_id AS long) AS vec_id", f"transform(embedding, v -> cast(floor({at.scale} * cast(v AS double)) AS long)) AS x"
    )


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact. Small numbers go through floating
    point, where all sums are whole numbers below 2**53; others through Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None, :]
    a, b = x.astype(object), centroids.astype(object)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1)


def looked_at(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the smaller number, and its gap: how much nearer it is
    than the second nearest, rounded down by more than the arithmetic's error."""
    d = squared(x, centroids)
    own = d.argmin(1)
    near = np.sqrt(d[np.arange(len(x)), own].astype(np.float64))
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    d[np.arange(len(x)), own] = d.max() + 1
    second = np.sqrt(d.min(1).astype(np.float64))
    return own, second - near - 1e-9 * (1 + second + near)


_BLOCK = pa.schema(
    [("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("own", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()),
     ("sizes", pa.list_(pa.int32())), ("looks", pa.int64()),
     ("moved", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])))]
)
BLOCK = (
    "ids array<long>, x binary, own binary, keys binary, places binary, sizes array<int>, looks long, "
    "moved array<struct<cluster: int, n: long, sums: array<long>>>"
)


class Block:
    """Vectors with their clusters and, per cluster, a heap of (gap + drift at the last look, place)."""

    def __init__(self, x: np.ndarray, own: np.ndarray, heaps: list):
        self.x, self.own, self.heaps, self.looks = x, own, heaps, 0

    @classmethod
    def of(cls, x: np.ndarray, centroids: np.ndarray) -> Block:
        """All vectors looked at for the first time; nothing has drifted yet."""
        own, gap = looked_at(x, centroids)
        block = cls(x, own.astype(np.int32), [list(zip(gap[own == j].tolist(), np.flatnonzero(own == j).tolist())) for j in range(len(centroids))])
        for heap in block.heaps:
            heapify(heap)
        block.looks = len(x)
        return block

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, dims: int) -> Block:
        x = np.frombuffer(batch.column("x")[i].as_py(), dtype=np.int64).reshape(-1, dims)
        own = np.frombuffer(batch.column("own")[i].as_py(), dtype=np.int32).copy()
        keys = np.frombuffer(batch.column("keys")[i].as_py(), dtype=np.float64)
        places = np.frombuffer(batch.column("places")[i].as_py(), dtype=np.int32)
        heaps, at = [], 0
        for size in batch.column("sizes")[i].as_py():
            heaps.append((keys[at : at + size], places[at : at + size]))
            at += size
        return cls(x, own, heaps)

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pop the vectors whose gap the drift has used up. A heap with none stays as it was read."""
        out = []
        for j, (keys, places) in enumerate(self.heaps):
            # The first key is the smallest of its heap.
            if not len(keys) or keys[0] > drift[j]:
                continue
            heap = list(zip(keys.tolist(), places.tolist()))
            while heap and heap[0][0] <= drift[j]:
                out.append(heappop(heap)[1])
            self.heaps[j] = heap
        return np.array(sorted(out), dtype=np.int64)

    def again(self, centroids: np.ndarray, drift: np.ndarray) -> dict:
        """Look at what has expired; per cluster the change of its number of vectors and of their sum."""
        places = self.expired(drift)
        if not len(places):
            return {}
        before = self.own[places].copy()
        own, gap = looked_at(self.x[places], centroids)
        self.own[places] = own
        self.looks += len(places)
        for key, j, place in zip((gap + drift[own]).tolist(), own.tolist(), places.tolist()):
            if isinstance(self.heaps[j], tuple):
                self.heaps[j] = list(zip(self.heaps[j][0].tolist(), self.heaps[j][1].tolist()))
            heappush(self.heaps[j], (key, place))
        moved = before != own
        return changes(self.x[places[moved]], before[moved], own[moved])

    def row(self, ids: list, moved: dict) -> pa.RecordBatch:
        flat = [h if isinstance(h, tuple) else ([k for k, _ in h], [p for _, p in h]) for h in self.heaps]
        keys = b"".join(np.asarray(k, dtype=np.float64).tobytes() for k, _ in flat)
        places = b"".join(np.asarray(p, dtype=np.int32).tobytes() for _, p in flat)
        told = [{"cluster": j, "n": n, "sums": sums} for j, (n, sums) in sorted(moved.items())]
        values = [[ids], [self.x.tobytes()], [self.own.astype(np.int32).tobytes()], [keys], [places], [[len(k) for k, _ in flat]], [self.looks], [told]]
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, _BLOCK)], schema=_BLOCK)


def changes(x: np.ndarray, left: np.ndarray, joined: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors more, components more) of vectors that left a cluster (-1: none) and joined one."""
    out = {}
    for j in sorted({*left.tolist(), *joined.tolist()} - {-1}):
        sums = x[joined == j].sum(0) - x[left == j].sum(0)
        out[j] = int((joined == j).sum()) - int((left == j).sum()), sums.tolist()
    return out


def _first(vectors: DataFrame, centroids: np.ndarray, at: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at.rows):
                part = batch.slice(start, at.rows)
                x = part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, at.dims)
                block = Block.of(x, centroids)
                moved = changes(x, np.full(len(x), -1), block.own)
                yield block.row(part.column(0).to_pylist(), moved)

    return vectors.select("vec_id", "x").mapInArrow(run, BLOCK)


def _again(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray, at: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(batch, i, at.dims)
                yield block.row(batch.column("ids")[i].as_py(), block.again(centroids, drift))

    return blocks.select(*_BLOCK.names).mapInArrow(run, BLOCK)


def _changes(blocks: DataFrame, count: list[int], sums: list[list[int]]) -> None:
    """Add the blocks' changes to the clusters' counts and sums: as many rows as centroids have components."""
    told = blocks.select(F.explode("moved").alias("m")).select("m.*")
    rows = told.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    for row in rows.collect():
        sums[row["cluster"]][row["d"]] += int(row["s"])
        if row["d"] == 0:
            count[row["cluster"]] += row["n"]


@dataclass
class Clusters:
    """centroids; blocks: the stored vectors with their last assignment; looks: vectors that were compared
    with all centroids, per assignment."""

    centroids: list[list[int]]
    blocks: DataFrame
    looks: list[int]


def fit(vectors: DataFrame, at: Settings = Settings()) -> Clusters | None:
    """Centroids after ``rounds`` rounds and the assignment to them; None without any vector. ``vectors`` is what
    ``kept`` returns. The first centroids are the vectors of smallest hash, ties by their components,
    vectors without id last."""
    code = F.sha2(F.concat(F.lit(at.salt), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select("x", code.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(at.clusters).collect()
    if not chosen:
        return None
    centroids = [list(r["x"]) for r in chosen]
    array = np.array(centroids, dtype=np.int64)
    blocks = stored(_first(vectors, array, at), "blocks")
    count, sums = [0] * len(centroids), [[0] * at.dims for _ in centroids]
    drift, looks = np.zeros(len(centroids)), []
    for _ in range(at.rounds):
        looks.append(blocks.agg(F.sum("looks")).first()[0])
        _changes(blocks, count, sums)
        moved = [[s // n for s in total] if n else old for n, total, old in zip(count, sums, centroids)]
        shift = np.array([float(sum((a - b) ** 2 for a, b in zip(new, old))) ** 0.5 for new, old in zip(moved, centroids)])
        shift *= 1 + 1e-9
        for j in range(len(centroids)):
            drift[j] += shift[j] + max((shift[i] for i in range(len(centroids)) if i != j), default=0.0)
        centroids = moved
        after = stored(_again(blocks, np.array(centroids, dtype=np.int64), drift.copy(), at), "blocks")
        discard(blocks)
        blocks = after
    looks.append(blocks.agg(F.sum("looks")).first()[0])
    return Clusters(centroids, blocks, looks)


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(vectors: DataFrame, at: Settings = Settings()) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` per vector that takes part.

    Vectors that are null, of another length or hold null or non-finite components are left out; a
    null id is kept; a repeated row is a vector of its own. Equal distances go to the smaller
    number. With fewer vectors than clusters each is a centroid; an empty table gives an empty
    one. Other columns are not read. Distances must stay below 2**63.
    """
    found = fit(kept(vectors, at), at)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    centroids, dims = np.array(found.centroids, dtype=np.int64), at.dims
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.int64).reshape(-1, dims)
                own = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int32)
                far = squared(x, centroids)[np.arange(len(x)), own]
                columns = [batch.column(0)[i].values, pa.array(own), pa.array([int(d) for d in far], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = found.blocks.select("ids", "x", "own").mapInArrow(run, "vec_id long, cluster int, distance long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(j, s, sum(sums.values()), digest[j]) for j, s in sums.items()]
    # One row per cluster.
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(at: Settings = Settings()) -> str:
    steps = [
        f"""v AS (
  SELECT row_number() OVER () AS i, vec_id, [CAST(floor({at.scale} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {at.dims} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS j, x AS c
  FROM (SELECT sha256('{at.salt}' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {at.clusters})
)"""
    ]
    for k in range(at.rounds + 1):
        steps.append(
            f"""a{k} AS (
  SELECT i, arg_min(j, d * {at.clusters} + j) AS j, min(d) AS d FROM (
    SELECT i, j, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN [[x[m], c[m]] FOR m IN range(1, {at.dims + 1})]]) AS HUGEINT) AS d FROM v, c{k})
  GROUP BY i
)"""
        )
        if k < at.rounds:
            steps.append(
                f"""s{k} AS (
  SELECT j, m, sum(x[m]) AS s, count(*) AS n FROM (SELECT j, x, unnest(range(1, {at.dims + 1})) AS m FROM a{k} JOIN v USING (i)) GROUP BY j, m
), c{k + 1} AS (
  SELECT c.j, coalesce(list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY m) FILTER (m IS NOT NULL), any_value(c)) AS c
  FROM c{k} c LEFT JOIN s{k} s ON s.j = c.j GROUP BY c.j
)"""
            )
    last = at.rounds
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (i) JOIN c{last} c ON c.j = a.j
"""


SQL = _sql()
