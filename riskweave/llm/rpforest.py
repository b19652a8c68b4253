"""Near-duplicate vectors by a forest of random-projection trees with overlapping halves.

In every tree a cell that holds too many vectors is split at the median of a random projection;
vectors near the cut go to both halves, so that a close pair is rarely parted. All pairs within a
leaf are compared; a pair that meets in several leaves counts in the one of the smallest number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import components, discard, stored


@dataclass(frozen=True)
class Forest:
    """cosine: least of a link; trees, levels: size of the forest; leaf: vectors that a cell may hold
    before it is split, and that are compared at once; tries: directions that may fail to split a
    cell before it is left whole; overlap: half width of the overlap, in
    standard deviations of the projected difference of a pair at the limit."""

    cosine: float = 0.93
    trees: int = 6
    levels: int = 24
    leaf: int = 512
    overlap: float = 0.6
    tries: int = 3
    seed: int = 20260701


FINE = (
    "label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND exists(embedding, v -> v != 0) AND "
    "forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(double(v)) < double('Infinity'))"
)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    # By the largest component first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


_ROWS = pa.schema([("id", pa.int64()), ("p", pa.list_(pa.list_(pa.float32())))])


def _projected(classes: DataFrame, at: Forest) -> DataFrame:
    """One row per vector and tree: its projections, one per level, in units of the overlap's half width."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                by_size: dict[int, list[int]] = {}
                vectors = part.column(1).to_pylist()
                for i, v in enumerate(vectors):
                    by_size.setdefault(len(v), []).append(i)
                for size, rows in by_size.items():
                    x = _unit([vectors[i] for i in rows])
                    d = np.random.Generator(np.random.PCG64(at.seed)).normal(size=(size, at.trees * at.levels))
                    d /= np.sqrt((d**2).sum(0))
                    width = at.overlap * np.sqrt(2 - 2 * at.cosine) / np.sqrt(size)
                    p = (x @ d / width).reshape(len(rows), at.trees, at.levels).tolist()
                    ids = part.column(0).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(p, _ROWS.field(1).type)], schema=_ROWS)

    rows = classes.select("id", "embedding").mapInArrow(run, "id long, p array<array<float>>")
    labels = classes.select("id", "label", F.size("embedding").alias("dim"))
    return labels.join(rows, "id").select("id", "label", "dim", F.posexplode("p").alias("tree", "p"))


def leaves(classes: DataFrame, at: Forest = Forest()) -> DataFrame:
    """``id`` and ``leaf``, a 64-bit number. ``classes`` has id, label, embedding; only vectors of one
    label and one length can share a leaf.

    A level is one grouped aggregate for the medians and one join, whatever the number of cells.
    Where half of a cell or more lies within the overlap of its cut, splitting would only copy
    it: it is left for the next level's direction. What no direction of ``tries`` levels in a row
    can split, such as a group of near copies, is one leaf and compared in blocks.
    """
    cell = ["label", "dim", "tree", "cell"]
    first = _projected(classes, at).withColumns({"cell": F.lit(1).cast("long"), "failed": F.lit(0)})
    open_rows = stored(first, "cells")
    done = []
    for level in range(at.levels + 1):
        sizes = open_rows.groupBy(*cell).agg(
            F.count("*").alias("size"),
            F.percentile_approx(F.expr(f"p[{min(level, at.levels - 1)}]"), [0.25, 0.5, 0.75], 2000).alias("q"),
        )
        sizes = sizes.withColumn("split", F.expr("q[2] - q[0] > 2"))
        marked = open_rows.join(sizes, cell)
        small = f"size <= {at.leaf} OR failed >= {at.tries}" if level < at.levels else "true"
        name = F.xxhash64("label", "dim", "tree", "cell").alias("leaf")
        done.append(stored(marked.where(small).where("size > 1").select("id", name), "leaves"))
        if level == at.levels:
            break
        large = marked.where(f"NOT ({small})").select(
            "id", "label", "dim", "tree", "p", F.expr("if(split, 0, failed + 1)").alias("failed"),
            F.explode(F.expr(
                f"filter(array(if(NOT split OR p[{level}] <= q[1] + 1, 2 * cell, NULL), "
                f"if(split AND p[{level}] >= q[1] - 1, 2 * cell + 1, NULL)), c -> c IS NOT NULL)"
            )).alias("cell"),
        )
        after = stored(large, "cells")
        discard(open_rows)
        open_rows = after
        if open_rows.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _local_roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that the links of a block reach from each of its rows."""
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (low == root).all():
            return root
        root = low


def links(found: DataFrame, classes: DataFrame, at: Forest = Forest()) -> DataFrame:
    """Rows ``id``, ``links``, ``root``: per block of a leaf, how many vectors a vector links to there
    and the smallest id that it reaches. No pair leaves its block.

    A leaf is dealt into blocks by a hash of the id and every two blocks are one group, so a group
    has two blocks of rows at most, however large the leaf.
    """
    listed = found.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    vectors = stored(classes.join(listed, "id").select("id", "embedding", "copies", "leaves"), "vectors")
    sizes = found.groupBy("leaf").agg(F.count("*").alias("size"))
    dealt = (
        found.join(sizes, "leaf")
        .withColumn("blocks", F.expr(f"cast(ceil(size / {at.leaf}) AS int)"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .selectExpr("leaf", "id", "own", "least(own, other) AS i", "greatest(own, other) AS j")
        .join(vectors, "id")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        ids, own, leaf = rows["id"].to_numpy(np.int64), rows["own"].to_numpy(), rows["leaf"].iloc[0]
        x = _unit(rows["embedding"].tolist())
        link = x @ x.T >= at.cosine
        np.fill_diagonal(link, False)
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            link &= own[:, None] != own[None, :]
        some = np.flatnonzero(link.any(1))
        if not len(some):
            return pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")
        link, ids = link[np.ix_(some, some)], ids[some]
        copies = rows["copies"].to_numpy(np.float64)[some]
        earlier = [np.asarray(v)[np.asarray(v) < leaf] for v in rows["leaves"].iloc[some]]
        names, column = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros((len(some), len(names) + 1), dtype=np.float32)
        held[np.repeat(np.arange(len(some)), [len(v) for v in earlier]), column] = 1
        new = link & (held @ held.T == 0)
        return pd.DataFrame({"id": ids, "links": np.rint(new @ copies).astype(np.int64), "root": _local_roots(link, ids)})

    return dealt.groupBy("leaf", "i", "j").applyInPandas(compare, "id long, links long, root long")


def near_vectors(vectors: DataFrame, at: Forest = Forest()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Vectors with equal labels link when their cosine in double precision is at least ``cosine``.
    Null labels, ids, vectors or components, zero vectors and those that are not finite link with
    nothing and are components of their own. Equal vectors of a label are one class, counted with
    its copies, so copies make no pairs. Rows with one id, label and vector are one vector; an id
    with several is as many vectors, each with links of its own. Other columns are not read; an
    empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fine = rows.where(FINE)
    classes = stored(
        fine.distinct()
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("id", F.monotonically_increasing_id()),  # of the class; fixed once it is stored
        "classes",
    )
    found = stored(links(leaves(classes, at), classes, at), "found")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.selectExpr("id AS a", "root AS b").where("a != b")).withColumnRenamed("component_id", "root")
    least = joined.join(classes.select("id", "least"), "id").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = joined.join(least, "root").select("id", "component_id")
    known = (
        classes.join(counted, "id", "left")
        .join(joined, "id", "left")
        .where("copies > 1 OR links IS NOT NULL")
        .select(
            "label", "embedding",
            F.expr("copies - 1 + coalesce(links, 0L)").alias("n_links"),
            F.expr("coalesce(component_id, least)").alias("component_id"),
        )
    )
    linked = rows.withColumn("fine", F.expr(FINE)).join(known, ["label", "embedding"], "left")
    return linked.select(
        "vec_id",
        F.expr("if(fine, coalesce(n_links, 0L), 0L)").alias("n_links"),
        F.expr("if(fine, coalesce(component_id, vec_id), vec_id)").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0 AND len([e FOR e IN embedding IF e <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(least(a, b)) AS component_id FROM r GROUP BY a
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""
