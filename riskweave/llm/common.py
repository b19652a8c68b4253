"""What the operators share: stored intermediate tables, word hashing in numpy, components of a link table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.readers import fresh_path

U64 = np.uint64
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Odd multiplier of the rolling hash, and the multipliers of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
BYTE_CODES = np.random.Generator(np.random.PCG64(20260701)).integers(1, 2**64, 256, dtype=np.uint64)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(most: int = 1000) -> None:
    """Hand rows with whole texts to Python some hundred at a time: with Spark's 10,000 a batch of
    texts and its copies in both processes take hundreds of MB a task."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not 0 < int(spark.conf.get(BATCH_ROWS)) <= most:
        spark.conf.set(BATCH_ROWS, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back: later stages start from the
    files, also when the executors that wrote them are gone. Shuffle files behind it go as soon
    as it is written."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a stored frame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that all bits of a rolling hash are usable."""
    x = x ^ (x >> U64(30))
    x = x * MIX1
    x ^= x >> U64(27)
    x = x * MIX2
    x ^= x >> U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        held = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return held


class RollingHash:
    """64-bit hashes of any substrings of one byte array, from prefix sums modulo 2**64.

    ``of(start, end)`` depends on the bytes and their number alone, not on their place.
    """

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.up, down = powers(len(data) + 1, base)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = BYTE_CODES[data]
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=self.prefix[1:])
        self.down = down

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        span = self.prefix[end] - self.prefix[start]
        span *= self.down[start]
        span += (end - start).astype(np.uint64) * MIX2
        return mix64(span)


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another as one byte array, and the place where each starts (one more: the end)."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), bounds


_WHITE = re.compile(rb"[ \t-\r]")


def word_blocks(text: bytes, size: int, context: int = 0) -> Iterator[bytes]:
    """A text in blocks of about ``size`` bytes that end with a word, each after the last ``context`` words
    of the text before it. Each has more words than that, unless the text has not. A word longer
    than a block is not parted."""
    at, before = 0, []
    while at < len(text):
        end, block = at, b""
        while end < len(text) and len(block.split(None, context)) <= context:
            found = _WHITE.search(text, min(len(text), end + size))
            end = found.end() if found else len(text)
            block = b" ".join([*before, text[at:end]])
        if not context or not at or text[at:end].strip():
            yield block
        before = block.rsplit(None, context)[-context:] if context else []
        at = end


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of a link table.

    ``links`` has long columns ``a`` and ``b``; the result ``id``, ``component_id`` holds every id
    that occurs in a link between two different ids. Large-star and small-star steps alternate
    until nothing changes, so the number of rounds grows with the logarithm of a component's
    size. Each round is a stored table. Rows of a busy id are combined before the shuffle for its
    minimum, and the join that follows is one that Spark splits at a busy key.
    """
    edges = stored(
        links.where("a != b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.expr("array(struct(v AS u, m AS v), struct(u AS u, m AS v))")).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = stored(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if tuple(state) == before:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
            )
        before = tuple(state)
