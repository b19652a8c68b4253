"""Token counts of whole texts; long ones in overlapping chunks that are joined where both sides agree.

A long text is cut into chunks that reach some way into the next one. Each chunk is encoded by
itself. Its ends are wrong, as merges there do not see what follows, but inside the overlap two
neighbours soon come to the same tokens. They are joined at a place where a token ends in both and
the token after it is the same in both.

Such a place is proven: a run of pieces is the encoding of its text if and only if every two
neighbours are the encoding of theirs, since the first merge over a border would happen in those
two alone as well. All pairs of the joined run are neighbours in one chunk or the other, so it is
the encoding of the whole text. Where no such place is found, the text is encoded again in longer
chunks with longer overlaps, up to one chunk.

That holds for pair merging by fixed scores, where characters are the first symbols and text is not
changed but for the space mark; ``Pieces`` refuses other models.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import discard, short_batches, stored

MARK = "▁"


@dataclass(frozen=True)
class Chunks:
    """chunk: characters from the start of one chunk to the next; overlap: further characters that a chunk
    holds; wider: factor of both for texts that could not be joined."""

    chunk: int = 1 << 15
    overlap: int = 512
    wider: int = 4


class Pieces:
    """The model and the bytes of the marked text that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = "   a　ﬁ é\t\n "
        if self.model.normalize(odd) != MARK + odd.replace(" ", MARK):
            raise ValueError("chunks need a model that leaves the text as it is and marks its start")
        ids = range(self.model.get_piece_size())
        pieces = [(self.model.is_byte(i), self.model.id_to_piece(i)) for i in ids]
        self.sizes = np.array([1 if is_byte else len(piece.encode()) for is_byte, piece in pieces], dtype=np.int64)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in bytes of the marked text, from the text's start on."""
        return np.cumsum(self.sizes[self.model.encode(text)]) - len(MARK.encode())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked_size(text: str) -> int:
    """Bytes of a text with the space mark for each space."""
    return len(text.encode()) + (len(MARK.encode()) - 1) * text.count(" ")


def splice(tail: np.ndarray, head: np.ndarray) -> tuple[int, int] | None:
    """Numbers of ``tail`` and of ``head`` up to the first place that both hold and whose next one is the
    same in both; None if there is none. Both are sorted ends of tokens of two chunks."""
    if len(tail) < 2 or len(head) < 2:
        return None
    _, a, b = np.intersect1d(tail[:-1], head[:-1], assume_unique=True, return_indices=True)
    agree = np.flatnonzero(tail[a + 1] == head[b + 1])
    return (int(a[agree[0]]) + 1, int(b[agree[0]]) + 1) if len(agree) else None


_CHUNK = pa.schema([("key", pa.string()), ("part", pa.int32()), ("text", pa.string())])


def _cut(texts: DataFrame, at: Chunks) -> DataFrame:
    """key, part, text of the chunks of each text, equal texts once."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for part, start in enumerate(range(0, max(1, len(text) - at.overlap), at.chunk)):
                    rows.append((key, part, text[start : start + at.chunk + at.overlap]))
                    held += len(rows[-1][2])
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNK)], schema=_CHUNK)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CHUNK)], schema=_CHUNK)

    short_batches(64)
    rows = texts.select("key", "text").mapInArrow(run, "key string, part int, text string")
    return rows.groupBy("key", "part").agg(F.first("text").alias("text"))


_ENDS = pa.schema([("key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])


def _encoded(chunks: DataFrame, path: str, at: Chunks) -> DataFrame:
    """key, part, n (tokens), and the ends of tokens in the overlap with the chunk before (from this
    chunk's start) and with the next one (from that one's start)."""

    def run(batches):
        model = pieces(path)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                ends = model.ends(text)
                reach = marked_size(text[: at.overlap])
                tail = ends - marked_size(text[: at.chunk])
                head = ends[: np.searchsorted(ends, reach, side="right")]
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(ends), head, tail[np.searchsorted(tail, 0) :]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ENDS)], schema=_ENDS)

    return chunks.mapInArrow(run, "key string, part int, n long, head array<int>, tail array<int>")


def _joined(encoded: DataFrame) -> DataFrame:
    """key, n_tokens (null where chunks could not be joined). Rows of a text pass one by one."""

    @F.pandas_udf("long")
    def overlap(n: pd.Series, tail: pd.Series, head: pd.Series) -> pd.Series:
        """Tokens of the chunk before and of this one that the other counts as well: n of the chunk
        before, less those behind the join, and less those of this one before it."""
        out = []
        for size, left, right in zip(n, tail, head):
            at = splice(left, right) if left is not None else None
            out.append(None if at is None else (len(left) - at[0]) + at[1])
        return pd.Series(out, dtype="Int64")

    before = Window.partitionBy("key").orderBy("part")
    rows = encoded.withColumns({"tail_before": F.lag("tail").over(before), "n_before": F.lag("n").over(before)})
    rows = rows.select("key", "part", "n", F.when(F.col("part") > 0, overlap("n_before", "tail_before", "head")).alias("twice"))
    return rows.groupBy("key").agg(
        F.expr("if(bool_or(part > 0 AND twice IS NULL), NULL, sum(n) - sum(coalesce(twice, 0L))) AS n_tokens")
    )


def long_counts(texts: DataFrame, path: str, at: Chunks = Chunks()) -> DataFrame:
    """``key`` and ``n_tokens`` of texts (``key``, ``text``; one key, one text), joined from chunks. Each round
    is a stored table; it holds the texts whose chunks could not be joined before."""
    rest, found = texts, []
    while True:
        counted = stored(_joined(_encoded(_cut(rest, at), path, at)), "counts")
        found.append(counted.where("n_tokens IS NOT NULL"))
        failed = counted.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        if len(found) > 1 and rest is not texts:
            before = rest
            rest = stored(rest.join(failed, "key", "left_semi"), "texts")
            discard(before)
        else:
            rest = stored(rest.join(failed, "key", "left_semi"), "texts")
        at = Chunks(at.chunk * at.wider, at.overlap * at.wider, at.wider)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def short_count(text: Column, path: str) -> Column:
    """Tokens of texts that are encoded in one go."""

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        model = pieces(path)
        return pd.Series([n for i in range(0, len(values), 64) for n in model.count(values.iloc[i : i + 64].tolist())], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, at: Chunks = Chunks()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row of ``docs``, as the model's library gives them.

    Begin, end and other special tokens are not added, and their strings in a text are text. A null
    text is empty and has no tokens. A null or repeated id is only passed through; a repeated row comes out again; an
    empty table gives an empty one. Other columns are not read. ``path`` must be readable on the
    executors. Texts up to a chunk and its overlap are encoded where they lie; of longer ones the
    chunks are dealt anew, so that one very long text keeps many tasks busy.
    """
    short_batches()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longer = F.length("text") > at.chunk + at.overlap
    small = rows.where(~longer).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), short_count(F.col("text"), path).alias("n_tokens"))
    keyed = rows.where(longer).withColumn("key", F.sha2("text", 256))
    counts = long_counts(keyed.select("key", "text"), path, at)
    large = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "key")
    every = small.unionByName(large.select("doc_id", "n_bytes", "n_tokens"))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
