"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slices(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first text and texts of about ``size`` bytes; a text that is much longer comes alone."""
    some, first, held = [], 0, 0
    for i, text in enumerate(texts):
        if some and len(text) > 2 * size:
            yield first, some
            some, first, held = [], i, 0
        some.append(text)
        held += len(text)
        if held >= size or i + 1 == len(texts):
            yield first, some
            some, first, held = [], i + 1, 0


def in_slices(batch: pd.Series, score, size: int) -> np.ndarray:
    """``score`` of some texts (bytes) at a time, in ``slices``."""
    out = np.empty(len(batch))
    for first, some in slices([(value or "").encode() for value in batch], size):
        out[first : first + len(some)] = score(some)
    return out


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document's labels may not be learned from: crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _lowest(df: DataFrame, code: str, rows: int, size: int) -> DataFrame:
    """The ``rows`` rows of lowest hash of about ``size``. Of a large table only those reach the sort
    that are below a bound that four times as many are expected to be below, so what tasks send
    does not grow with their number."""
    if size > 8 * rows:
        df = df.where(F.col(code) < -(2**63) + 2**64 * 4 * rows // size)
    return df.orderBy(code, "doc_id").limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, piece: int) -> pd.DataFrame:
    """``text`` and ``label`` of labelled documents that are not held out, for the driver.

    At most ``rows`` documents a class in the order of a hash of the id, of a longer one a piece of ``piece``
    characters at a place that the hash gives, and of those the first that hold ``chars`` characters together: the driver's memory
    has that bound at every size of the tables, and a class gets ``chars / piece`` documents at
    least where it has them. Null labels, ids or texts are left out; of several labels of an id
    the smallest counts. A class without any text among the chosen ids is chosen again among the
    ids that have one; an error tells when it is empty all the same.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .withColumn("n", F.xxhash64("doc_id"))
    )
    texts = _pieces(docs, chars, piece)

    def bounded(known: DataFrame) -> pd.DataFrame:
        sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
        first = [_lowest(known.where(F.col("label") == c), "n", rows, sizes.get(c, 0)) for c in (0, 1)]
        chosen = first[0].unionByName(first[1])
        # At most rows * 2 small rows: bounded, so the documents need no shuffle.
        found = texts.join(F.broadcast(chosen), "doc_id")
        found = found.groupBy("doc_id", "label", "n").agg(F.min("text").alias("text"))  # one text an id
        running = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy("n", "text"))
        found = found.withColumn("chars", running).where(F.col("chars") <= chars)
        return found.orderBy("label", "n", "text").select("text", "label").toPandas()

    taken = bounded(known)
    if rows and chars and taken["label"].nunique() < 2:
        there = known.join(texts.select("doc_id"), "doc_id", "left_semi")
        classes = there.agg(F.count_distinct("label")).first()[0]
        if classes > taken["label"].nunique():
            taken = bounded(there)
            if taken["label"].nunique() < classes:
                raise ValueError(f"no document of one class of {label} fits into {chars} characters")
    return taken


def _pieces(docs: DataFrame, chars: int, piece: int) -> DataFrame:
    """Ids and a piece of each text that is not null, the whole text where it is no longer."""
    size = min(piece, chars)
    place = f"cast(pmod(xxhash64(doc_id, 'piece'), greatest(1, length(text) - {size} + 1)) AS int)"
    return docs.where("text IS NOT NULL").selectExpr("doc_id", f"substring(text, 1 + {place}, {size}) AS text")


def unlabelled_sample(docs: DataFrame, rows: int, chars: int, piece: int) -> pd.DataFrame:
    """``text`` of at most ``rows`` documents, the lowest by a hash of the id, whatever their labels say;
    bounded by ``piece`` and ``chars`` as in ``sample``."""
    hashed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"))
    lowest = _lowest(hashed, "h", rows, docs.count())
    found = _pieces(docs, chars, piece).join(F.broadcast(lowest.distinct()), "doc_id")
    found = found.groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    running = F.sum(F.length("text")).over(Window.partitionBy().orderBy("h", "doc_id", "text"))
    return found.withColumn("chars", running).where(F.col("chars") <= chars).orderBy("h", "doc_id", "text").select("text").toPandas()
