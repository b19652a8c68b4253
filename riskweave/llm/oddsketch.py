"""Near-duplicate documents: banded MinHash, candidates checked by odd sketches, links confirmed on whole sets.

An odd sketch is a parity bitmap of a document's MinHash samples: each sample flips one bit. The
bits in which two sketches differ estimate how many samples differ, and most precisely for high
similarities, where few do.

Groups of copies make no pairs on the way. Equal sets are one class from the start. In a bucket of a
band the sketch of every class is compared with that of the bucket's smallest id; buckets that are
not connected by then are compared block by block. Classes that near sketches connect are a
cluster, and within it whole sets are compared: first all of them with that of the smallest id,
then with that of the smallest one left over, and so on for a few rounds. What no round has linked is compared
with the whole cluster, block by block; a block returns a star for each part that its links
connect and not the links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import RollingHash, components, discard, joined_bytes, mix64, short_batches, stored, word_blocks

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """words: words of a shingle; percent: least similarity of a link; bands, rows: the MinHash
    samples, of which a pair of similarity 0.8 shares a band in all but 7 of 100,000 cases; bits:
    size of the odd sketch; slack: how far below the limit an estimate may be and still be
    confirmed on the sets (over three standard deviations); block: classes whose sketches
    are compared at once; half as many sets are, or as many as have ``codes`` elements; hubs: rounds in which a cluster is
    compared with one of its sets; slice: bytes of text that are looked at together."""

    words: int = 4
    percent: int = 80
    bands: int = 24
    rows: int = 5
    bits: int = 512
    slack: float = 0.14
    block: int = 512
    codes: int = 400_000
    hubs: int = 2
    slice: int = 1 << 19

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def long_shingles(text: bytes, words: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of one long text, block by block, each with the last words of those before it."""
    found = np.unique(np.concatenate([np.empty(0, np.uint64), *[shingles([b], words)[1] for b in word_blocks(text, size, words - 1)]]))
    return np.zeros(len(found), np.int64), found


def sets_of(texts: list[bytes], at: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of texts as ``_texts`` hands them over."""
    if len(texts) == 1 and len(texts[0]) > 2 * at.slice:
        return long_shingles(texts[0], at.words, at.slice)
    return shingles(texts, at.words)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles, in that order. A text with fewer words has its
    whole sequence as one; a text without words has none."""
    data, bounds = joined_bytes([t + b"\n" for t in texts])
    data = _LOWER[data]
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    word = RollingHash(data).of(starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.minimum(count[doc], words)
    full = np.flatnonzero(np.arange(len(doc)) - first[doc] <= count[doc] - size)
    size = size[full]
    code = word[full].copy()
    for k in range(1, words):
        more = size > k
        code[more] = code[more] * _STEP + word[full[more] + k]
    code = mix64(code + size.astype(np.uint64))
    doc = doc[full]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[new], code[new]


def sketches_of(texts: list[bytes], at: Settings):
    """Per text: size of its set, two hashes of the set, hashes of the bands, odd sketch as bytes."""
    doc, code = sets_of(texts, at)
    n = np.bincount(doc, minlength=len(texts))
    some = np.flatnonzero(n)
    first = np.concatenate([[0], np.cumsum(n[some])[:-1]]).astype(np.int64)
    keys = np.zeros((2, len(texts)), dtype=np.uint64)
    bands = np.zeros((len(texts), at.bands), dtype=np.uint64)
    sketch = np.zeros((len(texts), at.bits), dtype=np.uint8)
    if len(some):
        keys[0, some] = np.add.reduceat(code, first)
        keys[1, some] = np.add.reduceat(mix64(code ^ _STEP), first)
        rng = np.random.Generator(np.random.PCG64(20260704))
        for k, odd in enumerate(rng.integers(1, 2**63, at.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
            # Multiplying by an odd number permutes the hashes; their high bits order them.
            low = mix64(np.minimum.reduceat(code * odd, first) + np.uint64(k))
            band = k // at.rows
            bands[some, band] = bands[some, band] * _STEP + low
            sketch[some, (low % np.uint64(at.bits)).astype(np.int64)] ^= 1
    return n, keys, bands, np.packbits(sketch, axis=1)


def similarity(different: np.ndarray, at: Settings) -> np.ndarray:
    """Estimate from the number of bits in which two odd sketches differ."""
    share = np.minimum(2 * different / at.bits, 1 - 1 / at.bits)
    return 1 + at.bits / (4 * at.samples) * np.log1p(-share)


def _texts(batch, size: int):
    """First row and texts of about ``size`` bytes of a batch; a text that is much longer comes alone."""
    texts, start, held = [], 0, 0
    column = batch.column(batch.schema.get_field_index("text")).cast("binary")
    for i in range(batch.num_rows):
        text = column[i].as_py() or b""
        if texts and len(text) > 2 * size:
            yield start, texts
            texts, start, held = [], i, 0
        texts.append(text)
        held += len(text)
        if held >= size or i + 1 == batch.num_rows:
            yield start, texts
            texts, start, held = [], i + 1, 0


_SKETCH = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
     ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
)


def sketched(docs: DataFrame, at: Settings = Settings()) -> DataFrame:
    """id, n, k1, k2 (the set's size and hashes), bands, sketch of whole texts."""

    def run(batches):
        for batch in batches:
            for start, texts in _texts(batch, at.slice):
                n, keys, bands, sketch = sketches_of(texts, at)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * at.bands)
                columns = [
                    batch.column(0).slice(start, len(texts)).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    *[pa.array(k.view(np.int64)) for k in keys],
                    pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64))),
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_SKETCH)

    short_batches()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, at: Settings) -> DataFrame:
    """id and codes, the whole set of every wanted class, from the text of its smallest document."""

    def run(batches):
        for batch in batches:
            for start, texts in _texts(batch, at.slice):
                doc, code = sets_of(texts, at)
                n = np.bincount(doc, minlength=len(texts))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), codes], ["id", "codes"])

    # A merge join at every size: the wanted ids grow with the documents.
    one = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
    # Rows with one id are one document; the larger set stands for it, whichever task meets it first.
    found = one.mapInArrow(run, "id long, codes array<long>")
    return found.groupBy("id").agg(F.max_by("codes", F.struct(F.size("codes"), F.xxhash64("codes"))).alias("codes"))


def _alike(pairs: DataFrame, classes: DataFrame, at: Settings) -> DataFrame:
    """The pairs (a, b) whose sizes and odd sketches allow a link."""
    side = classes.select("id", "n", "sketch")
    rows = (
        pairs.join(side.toDF("a", "na", "sa"), "a")
        .join(side.toDF("b", "nb", "sb"), "b")
        .where(f"100 * least(na, nb) >= {at.percent} * greatest(na, nb)")
    )
    least = at.percent / 100 - at.slack

    @F.pandas_udf("boolean")
    def near(sa: pd.Series, sb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (sa, sb))
        return pd.Series(similarity(np.bitwise_count(a ^ b).sum(1), at) >= least)

    return rows.where(near("sa", "sb")).select("a", "b")


def _local_roots(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that the links of a block reach from each of its rows."""
    root, none = ids.copy(), np.iinfo(np.int64).max
    while True:
        low = np.minimum(root, np.where(link, root[None, :], none).min(1, initial=none))
        if (low == root).all():
            return root
        root = low


def _in_blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """The rows of each group dealt into blocks by a hash of the id, once for every two blocks
    (``i``, ``j``; ``own`` is the row's): a group has two blocks of rows at most, however large."""
    sizes = rows.groupBy(*group).agg(F.expr(f"cast(ceil(count(*) / {block}) AS int)").alias("blocks")).hint("merge")
    return (
        rows.join(sizes, group)
        .withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("blocks", "other")
    )


_NO_EDGES = {"a": "int64", "b": "int64"}


def _edges(link: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """A star for each connected part of a block: as many rows as it has members, whatever its links."""
    root = _local_roots(link, ids)
    other = root != ids
    return pd.DataFrame({"a": root[other], "b": ids[other]})


def _near_in_buckets(members: DataFrame, at: Settings) -> DataFrame:
    """Edges (a, b) that connect what a bucket holds of different components, where sketches are near.

    ``members`` has band, code, id, component, n, sketch."""
    least = at.percent / 100 - at.slack

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, comps, n, own = (rows[c].to_numpy() for c in ("id", "component", "n", "own"))
        bits = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1).view(np.uint64)
        differ = np.zeros((len(rows), len(rows)), dtype=np.int32)
        for k in range(bits.shape[1]):
            differ += np.bitwise_count(bits[:, k, None] ^ bits[None, :, k])
        link = similarity(differ, at) >= least
        link &= 100 * np.minimum(n[:, None], n[None, :]) >= at.percent * np.maximum(n[:, None], n[None, :])
        link &= comps[:, None] != comps[None, :]
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            link &= own[:, None] != own[None, :]
        return _edges(link, ids)

    dealt = _in_blocks(members, ["band", "code"], at.block)
    return dealt.groupBy("band", "code", "i", "j").applyInPandas(compare, "a long, b long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, some thousand elements at a time."""
    names, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((len(sets), len(sets)))
    for start in range(0, len(names), 8192):
        low, high = np.searchsorted(column, (start, start + 8192))
        held = np.zeros((len(sets), 8192), dtype=np.float32)
        held[row[low:high], column[low:high] - start] = 1
        shared += held @ held.T
    return shared


def _hub_links(members: DataFrame, hubs: DataFrame, at: Settings) -> DataFrame:
    """cluster, a (the hub), b: the members whose whole sets are linked with their cluster's hub."""

    @F.pandas_udf("boolean")
    def linked(codes: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(codes, others):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * shared >= at.percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    sides = members.join(hubs.selectExpr("cluster", "id AS hub", "codes AS hub_codes"), "cluster")
    sizes = f"id != hub AND 100 * least(size(codes), size(hub_codes)) >= {at.percent} * greatest(size(codes), size(hub_codes))"
    return sides.where(sizes).where(linked("codes", "hub_codes")).selectExpr("cluster", "hub AS a", "id AS b")


def _linked(clusters: DataFrame, at: Settings) -> DataFrame:
    """Edges (a, b) over what links connect in each cluster, judged on whole sets.

    ``clusters`` has cluster, id, codes. In each round all sets of a cluster are compared with that of the
    smallest id that is linked with nothing yet, which costs one set a row. Of a link that the rounds
    have not found and that joins two parts, one end lies outside the cluster's largest part: what lies outside is compared with all in blocks."""
    edges, rest = None, clusters.select("cluster", "id")
    for _ in range(at.hubs):
        least = rest.groupBy("cluster").agg(F.min("id").alias("id"))
        hubs = stored(clusters.join(least, ["cluster", "id"]).select("cluster", "id", "codes"), "hubs")
        found = stored(_hub_links(clusters, hubs, at), "edges")
        edges = found if edges is None else edges.unionByName(found)
        done = found.selectExpr("b AS id").unionByName(hubs.select("id")).distinct()
        rest = stored(rest.join(done, "id", "left_anti").select("cluster", "id"), "open")
        discard(hubs)
        if rest.isEmpty():
            break
    parts = stored(components(edges.select("a", "b")), "components")
    placed = clusters.select("cluster", "id").join(parts, "id", "left").withColumn("part", F.coalesce("component_id", "id"))
    sizes = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("members", "part")).alias("largest"))
    rest = stored(placed.join(largest, "cluster").where("part != largest").select("id"), "open")
    if rest.isEmpty():
        return edges.select("a", "b")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, own = rows["id"].to_numpy(), rows["own"].to_numpy()
        if len(rows) < 2:
            return pd.DataFrame({"a": [], "b": []}).astype(_NO_EDGES)
        sets = [np.asarray(c, dtype=np.int64) for c in rows["codes"]]
        shared, size = _shared(sets), np.array([len(c) for c in sets])
        link = 100 * shared >= at.percent * (size[:, None] + size[None, :] - shared)
        np.fill_diagonal(link, False)
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            link &= own[:, None] != own[None, :]
        return _edges(link, ids)

    open_ids = rest.select("id").withColumn("open", F.lit(True))
    marked = clusters.join(open_ids, "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    dealt = _against_open(marked, at)
    more = dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")
    return edges.select("a", "b").unionByName(more)


def _against_open(rows: DataFrame, at: Settings) -> DataFrame:
    """The rows of each cluster that has open ones, dealt into blocks by a hash of the id: open rows into
    blocks from 0 on, the others into blocks behind those. Every two blocks of which one is open
    meet (``i``, ``j``; ``own`` is the row's)."""
    blocks = (
        f"cast(greatest(ceil(count_if({{0}}) / {at.block // 2}), ceil(coalesce(sum(if({{0}}, size(codes), 0)), 0) / {at.codes})) AS int)"
    )
    sizes = rows.groupBy("cluster").agg(
        F.expr(blocks.format("open")).alias("opened"), F.expr(blocks.format("NOT open")).alias("closed")
    )
    other = "if(open, sequence(0, opened + closed - 1), sequence(0, opened - 1))"
    return (
        rows.join(sizes.where("opened > 0").hint("merge"), "cluster")
        .withColumn("own", F.expr("if(open, cast(pmod(xxhash64(id), opened) AS int), opened + cast(pmod(xxhash64(id), closed) AS int))"))
        .withColumn("other", F.explode(F.expr(other)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("opened", "closed", "other", "open")
    )


def near_duplicates(docs: DataFrame, at: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct
    ``words``-word shingles; a component's id is the smallest id that links reach. Texts that are null
    or have no words have an empty set and no link. A row without id has no link and no component
    and is kept. Rows with the same id are one document and get the same component. Other columns
    are not read; an empty table gives an empty one.
    """
    found = stored(sketched(docs, at), "sketches")
    classes = found.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    classes = stored(classes, "classes")
    banded = classes.select("id", F.posexplode("bands").alias("band", "code"))
    buckets = banded.groupBy("band", "code").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    members = stored(banded.join(buckets.select("band", "code", "hub"), ["band", "code"]), "members")
    near = stored(_alike(members.where("id != hub").selectExpr("hub AS a", "id AS b").distinct(), classes, at), "near")
    joined = stored(components(near), "components")
    placed = members.join(joined, "id", "left").selectExpr("band", "code", "id", "coalesce(component_id, id) AS component")
    mixed = placed.groupBy("band", "code").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    rest = placed.join(mixed.where("x < y").select("band", "code"), ["band", "code"], "left_semi")
    more = stored(_near_in_buckets(rest.join(classes.select("id", "n", "sketch"), "id"), at), "near")
    discard(members)
    # All classes that may be linked are in one cluster; their sets are compared there.
    clusters = stored(components(near.unionByName(more)).withColumnRenamed("component_id", "cluster"), "clusters")
    sets = _sets(docs, clusters.select("id"), at)
    found_links = stored(_linked(stored(clusters.join(sets, "id"), "sets"), at), "edges")
    joined = stored(components(found_links), "components")
    # Classes of one document that is in no link are components of their own.
    where = classes.join(joined, "id", "left").selectExpr("k1", "k2", "copies", "coalesce(component_id, id) AS component_id", "component_id IS NOT NULL AS linked")
    where = where.where("copies > 1 OR linked").select("k1", "k2", "component_id")
    rows = found.select("id", "n", "k1", "k2").join(where, ["k1", "k2"], "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(own, F.col("id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
