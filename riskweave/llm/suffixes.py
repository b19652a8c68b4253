"""Repeated strings of bytes, found by prefix doubling over sampled positions.

Prefix doubling ranks every position by its first h bytes and then, pair by pair, by its first 2h.
Ranking every byte of a corpus would shuffle many times its size, so positions are sampled such
that equal strings of ``length`` bytes hold equal samples at equal places (minimizers): with
``seed`` the length of the first rank, each such string starts ``d`` bytes before a sample, for a
d from 0 to length - seed. Ranks are named by 64-bit hashes of the strings, since only equality
counts, and a position whose rank is unique is finished.

1. Samples are ranked by their ``seed`` bytes; unique ones drop out.
2. They are ranked by all bytes that strings around them can hold (the hull). Where two share it,
   every string around them repeats, and they are finished as well.
3. The others are at the edges of repeats. A group of equal rank compares all its strings. A group
   of more than ``most`` rows is ranked anew by pairs (rank, next bytes) that reach further, half of the
   values of d to the left and half to the right, and by their hulls again, until groups are small,
   positions are unique or the rank covers ``length`` bytes, when equal rank is the answer.

Matching is by hashes of 64 bits and of a group's rank; nothing else is approximate.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import RollingHash, discard, joined_bytes, short_batches, stored

#: Strings of a group that are compared at a time, and the least rows that are held for it.
BLOCK = 1 << 18
#: Second base, for hashes that are independent of the first.
BASE2 = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Lengths:
    """length: bytes of a string that must not repeat; seed: bytes of the first rank; most: largest
    group whose strings are compared directly; slice: bytes of text that are looked at together."""

    length: int = 200
    seed: int = 73
    most: int = 4096
    slice: int = 1 << 19

    @property
    def spread(self) -> int:
        return self.length - self.seed + 1


def _slide(values: np.ndarray, width: int, choose) -> np.ndarray:
    """choose (minimum or maximum) over each run of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = choose(values[:-span], values[span:])
        span *= 2
    return choose(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def samples(texts: list[bytes], at: Lengths, first: int = 0, last: int | None = None):
    """(text number, place, rank, hull) of the sampled positions of some texts.

    A position is sampled when its hash is the smallest of a window of ``spread`` positions that
    are the possible seeds of one string inside its text; of equal ones all are. Only strings that
    start from ``first`` to before ``last`` count, where they are given.
    """
    data, bounds = joined_bytes(texts)
    if len(data) < at.length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    roll = RollingHash(data)
    place = np.arange(len(data) - at.seed + 1)
    ranks = roll.of(place, place + at.seed)
    least = _slide(ranks, at.spread, np.minimum)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = owner[: len(least)] == owner[at.length - 1 :]
    inside[:first] = False
    inside[last if last is not None else len(inside) :] = False
    # The largest minimum of the windows over a position is its own hash if and only if it is one.
    padded = np.zeros(len(ranks) + at.spread - 1, dtype=np.uint64)
    padded[at.spread - 1 : at.spread - 1 + len(least)] = np.where(inside, least, 0)
    chosen = np.flatnonzero((_slide(padded, at.spread, np.maximum) == ranks) & (ranks > 0))
    text = owner[chosen]
    left = np.maximum(chosen - (at.spread - 1), bounds[text])
    right = np.minimum(chosen + at.length, bounds[text + 1])
    hull = RollingHash(data, BASE2).of(left, right) ^ ((chosen - left) * 0x1F123BB5 + 1).astype(np.uint64)
    return text, chosen - bounds[text], ranks[chosen], hull


def long_samples(text: bytes, at: Lengths):
    """(place, rank, hull) of the sampled positions of a long text, slice by slice. A slice holds what
    its strings and their hulls reach, and leaves out what the slice before it has found."""
    margin, size, found = at.spread - 1, at.slice, np.empty(0, np.int64)
    for begin in range(0, len(text) - at.length + 1, size):
        start, stop = max(0, begin - margin), begin + size - 1 + at.length + margin
        _, place, rank, hull = samples([text[start:stop]], at, begin - start, begin - start + size)
        place = place + start
        new = ~np.isin(place, found)
        found = place[place >= begin + size]
        yield place[new], rank[new], hull[new]


def _parts(batch, size: int):
    """Row numbers of an Arrow batch whose texts hold about ``size`` bytes, with the texts. A text that
    is much longer comes alone."""
    texts, rows, held = [], [], 0
    column = batch.column(batch.schema.get_field_index("text")).cast("binary")
    for i in range(batch.num_rows):
        value = column[i].as_py()
        if value and len(value) > 2 * size:
            if rows:
                yield rows, texts
            yield [i], [value]
            texts, rows, held = [], [], 0
            continue
        texts.append(value or b"")
        rows.append(i)
        held += len(texts[-1])
        if held >= size:
            yield rows, texts
            texts, rows, held = [], [], 0
    if rows:
        yield rows, texts


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def row_key() -> Column:
    """What names a document: its id may be null or repeat, equal rows need not be told apart."""
    return F.xxhash64("doc_id", "text")


_SAMPLES = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("rank", pa.int64()), ("hull", pa.int64())])


def _sampled(docs: DataFrame, at: Lengths) -> DataFrame:
    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            for rows, texts in _parts(batch, at.slice):
                if len(texts[0]) > 2 * at.slice:
                    for place, rank, hull in long_samples(texts[0], at):
                        row = np.full(len(place), key[rows[0]])
                        yield _batch(_SAMPLES, row, place.astype(np.int32), rank.view(np.int64), hull.view(np.int64))
                    continue
                text, place, rank, hull = samples(texts, at)
                if len(text):
                    yield _batch(_SAMPLES, key[rows[0] + text], place.astype(np.int32), rank.view(np.int64), hull.view(np.int64))

    short_batches()
    return docs.select("row", "text").mapInArrow(run, "row long, place int, rank long, hull long")


_CONTEXT = pa.schema(
    [("row", pa.int64()), ("place", pa.int32()), ("copies", pa.int64()), ("rank", pa.int64()),
     ("hull", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("left", pa.int32()), ("context", pa.binary())]
)
CONTEXT = "row long, place int, copies long, rank long, hull long, low int, high int, left int, context binary"


def _contexts(docs: DataFrame, wanted: DataFrame, at: Lengths) -> DataFrame:
    """The bytes around wanted positions (row, place, rank, copies), at most one row each."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("place", "rank", "copies")).alias("wanted"))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for i in range(batch.num_rows):
                text, items = batch.column(1)[i].as_py() or b"", lists[i].values
                place, rank, copies = (items.field(n).to_numpy() for n in ("place", "rank", "copies"))
                left = np.minimum(place, at.spread - 1)
                for start in range(0, len(place), 4096):
                    part = slice(start, start + 4096)
                    n = len(place[part])
                    around = [text[p - m : p + at.length] for p, m in zip(place[part].tolist(), left[part].tolist())]
                    row, zero = np.full(n, batch.column(0)[i].as_py()), np.zeros(n, np.int32)
                    yield _batch(_CONTEXT, row, place[part], copies[part], rank[part], zero.astype(np.int64), zero, zero + at.spread - 1, left[part], around)

    one = docs.select("row", F.col("text").cast("binary").alias("text"))
    return one.join(lists, "row").mapInArrow(run, CONTEXT)


def _windows(left: np.ndarray, context: list[bytes], low: int, high: int, at: Lengths) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings that start d bytes before each row's position, d from ``low`` to ``high``, and
    which of them are inside the row's text. Contexts are hashed some thousand at a time."""
    d = np.arange(low, high + 1)
    codes, ok = np.zeros((len(context), len(d)), dtype=np.uint64), np.zeros((len(context), len(d)), dtype=bool)
    for first in range(0, len(context), 2048):
        data, bounds = joined_bytes(context[first : first + 2048])
        start = bounds[:-1, None] + left[first : first + 2048, None] - d[None, :]
        inside = (start >= bounds[:-1, None]) & (start + at.length <= bounds[1:, None])
        start = start[inside]
        codes[first : first + 2048][inside] = RollingHash(data, BASE2).of(start, start + at.length)
        ok[first : first + 2048] = inside
    return codes, ok


_FOUND = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
FOUND = "row long, first long, last long"


def _solve(groups: DataFrame, at: Lengths) -> DataFrame:
    """Runs of starts (row, first, last) of strings that occur twice in a group of equal rank.

    Rows come sorted by rank and d, so a piece of a partition that ends with a group is compared
    at once; a group has at most ``most`` rows."""

    def flush(batch):
        low, rank = batch.column("low").to_numpy(), batch.column("rank").to_numpy()
        for value in np.unique(low):
            part = batch.filter(pa.array(low == value))
            context = part.column("context").to_pylist()
            left, place = part.column("left").to_numpy(), part.column("place").to_numpy().astype(np.int64)
            names = rank[low == value].view(np.uint64) * np.uint64(BASE2)
            single, key = part.column("copies").to_numpy() == 1, part.column("row").to_numpy()
            codes, ok = _windows(left, context, int(value), int(part.column("high")[0].as_py()), at)
            # Some values of d at a time, which bounds the arrays.
            step = max(1, BLOCK // len(context))
            for d0 in range(0, codes.shape[1], step):
                row, d = np.nonzero(ok[:, d0 : d0 + step])
                code = codes[row, d + d0]
                d = d + (d0 + int(value))
                code = code ^ names[row] ^ (d.astype(np.uint64) << np.uint64(40))
                order = np.argsort(code, kind="stable")
                same = np.zeros(len(code) + 1, dtype=bool)
                same[1:-1] = code[order[1:]] == code[order[:-1]]
                again = np.zeros(len(code), dtype=bool)
                again[order] = same[1:] | same[:-1]
                # The strings of a position that stands for several equal ones are known already.
                again &= single[row]
                row, start = row[again], (place[row] - d)[again]
                if not len(row):
                    continue
                order = np.lexsort((start, row))
                row, start = row[order], start[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(new)
                yield _batch(_FOUND, key[row[first]], start[first], start[np.append(first[1:], len(row)) - 1])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < 4096:
                continue
            table = pa.concat_tables(held)
            rank, low = table.column("rank").to_numpy(), table.column("low").to_numpy()
            ends = np.flatnonzero((rank[1:] != rank[:-1]) | (low[1:] != low[:-1])) + 1
            # Whole groups, some thousand rows of them at a time.
            done = 0
            for cut in ends[np.searchsorted(ends, np.arange(4096, ends[-1] + 4096, 4096)).clip(max=len(ends) - 1)] if len(ends) else []:
                if cut > done:
                    yield from flush(table.slice(done, cut - done).combine_chunks().to_batches()[0])
                    done = cut
            held, rows = [table.slice(done)], 0
        if held and (table := pa.concat_tables(held)).num_rows:
            yield from flush(table.combine_chunks().to_batches()[0])

    return groups.select(*_CONTEXT.names).mapInArrow(run, FOUND)


def _doubled(large: DataFrame, at: Lengths) -> DataFrame:
    """The two halves of each row's strings, each ranked by the pair of the rank so far and the
    further bytes that all strings of the half hold."""

    def run(batches):
        for batch in batches:
            context, left = batch.column("context").to_pylist(), batch.column("left").to_numpy().astype(np.int64)
            low, high = (batch.column(n).to_numpy().astype(np.int64) for n in ("low", "high"))
            rank = batch.column("rank").to_numpy().view(np.uint64)
            data, bounds = joined_bytes(context)
            roll = RollingHash(data, BASE2)
            middle = (low + high) // 2
            for lo, hi in ((low, middle), (middle + 1, high)):
                # All strings of the half hold the bytes from lo before the position on, up to
                # length - hi after it.
                start, end = bounds[:-1] + left - lo, bounds[:-1] + left + at.length - hi
                ok = np.flatnonzero((start >= bounds[:-1]) & (end <= bounds[1:]) & (lo <= hi))
                if not len(ok):
                    continue
                pair = roll.of(start[ok], end[ok]) ^ (rank[ok] * np.uint64(BASE2))
                outer = np.maximum(bounds[:-1] + left - hi, bounds[:-1]), np.minimum(bounds[:-1] + left + at.length - lo, bounds[1:])
                hull = roll.of(outer[0][ok], outer[1][ok]) ^ ((bounds[:-1] + left - outer[0])[ok].astype(np.uint64) * np.uint64(0x1F123BB5))
                part = batch.take(pa.array(ok))
                part = part.set_column(part.schema.get_field_index("hull"), "hull", pa.array(hull.view(np.int64)))
                part = part.set_column(part.schema.get_field_index("rank"), "rank", pa.array(pair.view(np.int64)))
                part = part.set_column(part.schema.get_field_index("low"), "low", pa.array(lo[ok].astype(np.int32)))
                yield part.set_column(part.schema.get_field_index("high"), "high", pa.array(hi[ok].astype(np.int32)))

    return large.select(*_CONTEXT.names).mapInArrow(run, CONTEXT)


def repeated_starts(docs: DataFrame, at: Lengths = Lengths()) -> DataFrame:
    """``row``, ``first``, ``last``: runs of starts in a document (bytes, from 0, both included) of
    strings of ``length`` bytes that start anywhere else as well. ``docs`` has ``row`` and ``text``.
    Runs may overlap and reach past the last start that a text allows.
    """
    found = stored(_sampled(docs, at), "samples")
    # Stored before the join, so that Spark can split the join at a rank that very many positions share.
    again = stored(found.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), "ranks")
    ranked = stored(found.join(again.hint("merge"), "rank", "left_semi"), "samples")
    discard(found)
    discard(again)
    hulls = ranked.groupBy("rank", "hull").agg(
        F.count("*").alias("copies"), F.min(F.struct("row", "place")).alias("one")
    )
    hulls = stored(hulls.select("rank", "hull", "copies", "one.row", "one.place"), "hulls")
    whole = ranked.join(hulls.where("copies > 1").select("rank", "hull"), ["rank", "hull"], "left_semi")
    runs = [stored(whole.selectExpr("row", f"cast(place - {at.spread - 1} AS long) AS first", "cast(place AS long) AS last"), "runs")]
    discard(ranked)
    # Ranks that have an edge: there, one position of each hull is compared.
    edges = hulls.groupBy("rank").agg(F.count("*").alias("n"), F.min("copies").alias("least"))
    edges = edges.where("n > 1 AND least = 1").select("rank")
    wanted = hulls.join(edges, "rank", "left_semi").select("row", "place", "rank", "copies")
    open_rows = stored(_contexts(docs, wanted, at), "edges")
    discard(hulls)
    while True:
        sizes = open_rows.groupBy("rank", "low", "high").agg(F.count("*").alias("n"), F.min("copies").alias("least"))
        sizes = sizes.where("n > 1 AND least = 1")
        small = sizes.where((F.col("n") <= at.most) & (F.col("low") < F.col("high"))).select("rank", "low", "high")
        ready = open_rows.join(small, ["rank", "low", "high"], "left_semi")
        ready = ready.repartition("rank", "low").sortWithinPartitions("rank", "low")
        runs.append(stored(_solve(ready, at), "runs"))
        equal = sizes.where("low = high").select("rank", "low", "high")
        leaf = open_rows.where("low = high AND copies = 1").join(equal, ["rank", "low", "high"], "left_semi")
        runs.append(stored(leaf.selectExpr("row", "cast(place - low AS long) AS first", "cast(place - low AS long) AS last"), "runs"))
        large = sizes.where((F.col("n") > at.most) & (F.col("low") < F.col("high"))).select("rank", "low", "high")
        if large.isEmpty():
            break
        halves = stored(_doubled(open_rows.join(large, ["rank", "low", "high"], "left_semi"), at), "edges")
        discard(open_rows)
        node = ["rank", "low", "high", "hull"]
        shared = halves.groupBy(*node).agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one"))
        shared = halves.join(shared.where("n > 1"), node, "left")
        equal = shared.where("n > 1 AND copies = 1")
        runs.append(stored(equal.selectExpr("row", "cast(place - high AS long) AS first", "cast(place - low AS long) AS last"), "runs"))
        alone = shared.where("n IS NULL OR (row = one.row AND place = one.place)")
        open_rows = stored(alone.withColumn("copies", F.expr("coalesce(n, copies)")).select(*_CONTEXT.names), "edges")
        discard(halves)
    all_runs = runs[0]
    for more in runs[1:]:
        all_runs = all_runs.unionByName(more)
    return all_runs


def removed(text: bytes, first, last, length: int) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of bytes that the strings cover which start from a ``first`` to its ``last``."""
    first = np.maximum(np.asarray(first, dtype=np.int64), 0)
    last = np.minimum(np.asarray(last, dtype=np.int64), len(text) - length)
    first, last = first[first <= last], last[first <= last]
    if not len(first):
        return []
    order = np.argsort(first)
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return list(zip(first[new].tolist(), end[np.append(np.flatnonzero(new)[1:], len(first)) - 1].tolist()))


def left_over(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    begins, ends = [0, *[e for _, e in gone]], [*[b for b, _ in gone], len(text)]
    return b"".join([text[b:e] for b, e in zip(begins, ends)])


def _runs(batch, i: int, column: int) -> np.ndarray:
    """The numbers of a list column of a row; none where it is null."""
    held = batch.column(column)[i]
    return held.values.to_numpy() if held.is_valid else np.empty(0, np.int64)


def with_runs(docs: DataFrame, at: Lengths = Lengths()) -> DataFrame:
    """All columns of ``docs`` but the text (as the struct ``doc``), ``text`` as bytes and ``first`` and
    ``last``, the ends of its runs of repeated starts, null if there is none."""
    keyed = docs.select(row_key().alias("row"), "text")
    runs = repeated_starts(keyed, at)
    lists = runs.distinct().groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rest = [c for c in docs.columns if c != "text"]
    whole = docs.select(
        row_key().alias("row"), F.struct(*[f"`{c}`" for c in rest]).alias("doc"), F.col("text").cast("binary").alias("text")
    )
    return whole.join(lists, "row", "left").select("doc", "text", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


def digests(docs: DataFrame, at: Lengths = Lengths()) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, digest of what is left.

    A null text is empty; a text shorter than ``length`` loses nothing; of two equal rows each
    repeats the other; an empty table gives an empty one. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                gone = removed(text, _runs(batch, i, 2), _runs(batch, i, 3), at.length)
                kept = left_over(text, gone)
                out.append((batch.column(0)[i].as_py(), len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            if out:
                yield _batch(_DIGEST, *zip(*out))

    rows = with_runs(docs.select("doc_id", "text"), at).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "text", "first", "last")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, at: Lengths = Lengths()) -> DataFrame:
    """The documents without their repeated strings, columns as in ``docs``. A character of which a
    byte goes is left out; ``n_chars`` is that of the new text; a null text stays null."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for value, starts, ends in zip(text, first, last):
            if value is None or starts is None:
                out.append(None if value is None else value.decode())
            else:
                out.append(left_over(value, removed(value, starts, ends, at.length)).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    rows = with_runs(docs, at).withColumn("new_text", cut("text", "first", "last"))
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
