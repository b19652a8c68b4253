"""Phrase collocations by Rabin-Karp fingerprints of every n-gram.

The words of some texts are laid out one after another with one space between them. Prefix
polynomials over these bytes give the fingerprint of any run of words by two look-ups. A shuffle
adds up fingerprints, each with the key of one document that holds it; only those that occur often
enough are read back from that document's text and become phrases.

Twenty bits of a second polynomial, independent of the first, are added up as well. Where the sum
is that of the text that was read back, all occurrences are that phrase (but for one in a million
of the phrases that share a fingerprint of 61 bits); where not, two phrases share it, and those
are counted anew from the texts, by the phrase itself.

Three and four words can be frequent only if all their neighbouring pairs are, so the second scan
keeps what a bitmap of the frequent pairs' fingerprints lets through. It has a set size at most: a
fuller one lets more rows through, and drops none that count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import RollingHash, discard, joined_bytes, mix64, short_batches, stored

U64 = np.uint64
BASE2 = 0xD6E8FEB86659FD93
#: Bytes that are hashed at once, and rows of n-grams that a task adds up before it hands them on.
SLICE, HELD = 1 << 18, 3 << 18
#: Parts in which a language's phrases are ranked before their best meet.
PARTS = 16
#: What is kept of the second hash: sums of 20 bits stay below 2**63 for 8 * 10**12 occurrences.
SECOND = U64((1 << 20) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: byte of a word, 1: between words, 2: end of a piece.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_SEPARATOR, _PIECE_END = re.compile(rb"[ \t.,;:!?\n-\r]"), re.compile(rb"[.,;:!?\n-\r]")


@dataclass(frozen=True)
class Settings:
    """least: occurrences of a frequent phrase; longest: words of a phrase, 4 at most; contained:
    percent of a phrase's occurrences that a longer one around it must have for the phrase to go;
    top: phrases per language; bits: of a fingerprint; most_bits: binary logarithm of the bitmap's
    greatest size in bits."""

    least: int = 30
    longest: int = 4
    contained: int = 80
    top: int = 2000
    bits: int = 61
    most_bits: int = 27


class Words:
    """The words of some texts and the fingerprints of their n-grams. ``seeds`` stands for each
    text's language, ``known`` is how many of its first words are only there as context."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray, known: np.ndarray, bits: int):
        data, bounds = joined_bytes([t + b"\n" for t in texts])
        data = _LOWER[data]
        kind = _KIND[data]
        word = kind == 0
        before = np.concatenate([[False], word[:-1]])
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
        self.owner = np.searchsorted(bounds, starts, side="right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
        nth = np.arange(len(starts)) - np.searchsorted(self.owner, np.arange(len(texts)))[self.owner]
        self.new = nth >= known[self.owner]
        data = data.copy()
        data[ends] = 32
        keep = word
        keep[ends] = True
        self.data = data[keep]
        size = ends - starts
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.seed, self.bits = seeds[self.owner], bits
        self.hashes = RollingHash(self.data), RollingHash(self.data, BASE2)

    def at(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie in one piece and do not end in the context."""
        last = np.arange(n - 1, len(self.start))
        return np.flatnonzero((self.piece[last - (n - 1)] == self.piece[last]) & self.new[last])

    def codes(self, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint, its lowest three bits being n, and second hash of n-grams."""
        seed, start, end = self.seed[first], self.start[first], self.end[first + n - 1]
        code, check = (mix64(h.of(start, end) + seed) for h in self.hashes)
        return _fingerprint(code, n, self.bits), check

    def phrase(self, first: int, n: int) -> bytes:
        return self.data[self.start[first] : self.end[first + n - 1]].tobytes()


def _fingerprint(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    return (code >> U64(64 - bits) << U64(3)) | U64(n)


def _blocks(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in blocks of about SLICE bytes that end with a word, each after the last words of its
    piece so far, and the number of those. A word longer than a block is not parted."""
    at, context = 0, []
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            found = _SEPARATOR.search(text, at + SLICE)
            end = found.end() if found else end
        block = b" ".join([*context, text[at:end]])
        yield block, len(context)
        if end < len(text):
            context = re.findall(rb"[^ \t]+", _PIECE_END.split(block)[-1])[-3:]
        at = end


def _slices(batches, bits: int):
    """Words of about SLICE bytes of text at a time, with the document of each of their texts
    (number of the row in its batch) and the batch. Columns: row, seed, text, ..."""
    for batch in batches:
        seeds = batch.column(1).to_numpy().view(np.uint64)
        column = batch.column(2)
        texts, rows, known, held = [], [], [], 0
        for i in range(batch.num_rows):
            for text, context in _blocks(column[i].as_py() or b""):
                texts.append(text)
                rows.append(i)
                known.append(context)
                held += len(text)
                if held >= SLICE:
                    yield Words(texts, seeds[rows], np.array(known), bits), np.array(rows), batch
                    texts, rows, known, held = [], [], [], 0
        if texts:
            yield Words(texts, seeds[rows], np.array(known), bits), np.array(rows), batch


def _combined(codes: list[np.ndarray], rows: list[np.ndarray], sums: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Rows of one fingerprint added up; the smallest document key stands for them."""
    code = np.concatenate(codes)
    order = np.argsort(code)
    code = code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return code, code.view(np.int64), *[code.view(np.int64) for _ in sums]
    added = [np.add.reduceat(np.concatenate(s)[order], first) for s in sums]
    return code[first], np.minimum.reduceat(np.concatenate(rows)[order], first), *added


def _keyed(docs: DataFrame) -> DataFrame:
    """row, seed, text, lang: a document's key, its language as a number, its bytes. Documents may share
    a key: what is looked for is found in one of them by its fingerprint."""
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return docs.where("text IS NOT NULL").select(
        F.xxhash64("doc_id", "lang", "text").bitwiseAND(F.lit((1 << 32) - 1)).alias("row"), F.xxhash64(lang).alias("seed"),
        F.col("text").cast("binary").alias("text"), lang.alias("lang"),
    )


_GRAMS = pa.schema([("code", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("second", pa.int64())])


def _counted(keyed: DataFrame, choose, at: Settings) -> DataFrame:
    """code, f, row, second of the fingerprints that ``choose`` yields from Words as (n, first words) and
    that occur ``least`` times: number, a document that holds it, sum of the second hash's bits."""

    def run(batches):
        parts, held = [], 0

        def flush():
            code, row, n, second = zip(*parts)
            columns = _combined(code, row, [n, second])
            for start in range(0, len(columns[0]), 1 << 16):
                part = [c[start : start + (1 << 16)].view(np.int64) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], schema=_GRAMS)

        for words, rows, batch in _slices(batches, at.bits):
            row = batch.column(0).to_numpy()[rows]
            for n, first in choose(words):
                if n:
                    code, check = words.codes(first, n)
                    part = _combined([code], [row[words.owner[first]]], [[np.ones(len(first), np.int64)], [(check & SECOND).view(np.int64)]])
                else:  # the number of words, as that of empty phrases
                    seed, where, count = np.unique(words.seed[first], return_index=True, return_counts=True)
                    part = _fingerprint(mix64(seed), 0, at.bits), row[words.owner[first[where]]], count, 0 * count
                parts.append(part)
                held += len(part[0])
            if held >= HELD:
                yield from flush()
                parts, held = [], 0
        if parts:
            yield from flush()

    short_batches()
    found = keyed.select("row", "seed", "text").mapInArrow(run, "code long, row long, n long, second long")
    summed = found.groupBy("code").agg(F.sum("n").alias("f"), F.min("row").alias("row"), F.sum("second").alias("sums"))
    return stored(summed.where(F.col("f") >= at.least), "grams")


class Bitmap:
    """One bit per fingerprint modulo a power of two."""

    def __init__(self, codes: DataFrame, most_bits: int):
        rows = codes.count()
        self.bits = min(most_bits, max(16, int(32 * rows).bit_length()))
        place = F.shiftright("code", 3).bitwiseAND(F.lit((1 << self.bits) - 1))
        bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
        # As many rows as the bitmap has words at most.
        words = (
            codes.select(place.alias("place"))
            .groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(bit).alias("bits"))
            .toArrow()
        )
        self.words = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        place = codes >> U64(3) & U64((1 << self.bits) - 1)
        return (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1)).astype(bool)


def _longer(words: Words, pairs: Bitmap, longest: int):
    """The n-grams of three words and more whose neighbouring pairs are all in the bitmap."""
    good = np.zeros(len(words.start), dtype=bool)
    every = np.arange(len(words.start) - 1)
    every = every[words.piece[every] == words.piece[every + 1]] if len(every) else every
    good[every[pairs.holds(words.codes(every, 2)[0])]] = True
    for n in range(3, longest + 1):
        first = words.at(n)
        for k in range(n - 1):
            first = first[good[first + k]]
        yield n, first


_PHRASES = pa.schema([("code", pa.int64()), ("second", pa.int64()), ("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])
PHRASES = "code long, second long, lang string, phrase binary, f long"


def _spelled(words: Words, rows, langs, longest: int, chosen) -> Iterator[tuple]:
    """(code, second hash, lang, phrase, number) of the phrases whose fingerprints ``chosen`` lets through."""
    for n in range(0, longest + 1):
        first = words.at(max(n, 1))
        if not n:
            codes = _fingerprint(mix64(words.seed[first]), 0, words.bits)
            checks = words.seed[first]
        else:
            codes, checks = words.codes(first, n)
        ok = np.flatnonzero(chosen(codes))
        # Phrases that share a fingerprint are told apart by the whole second hash.
        code, check = codes[ok], checks[ok]
        order = np.lexsort((check, code))
        code, check, place = code[order], check[order], first[ok[order]]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (check[1:] != check[:-1])
        begin = np.flatnonzero(new)
        for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(code)]):
            i = place[b]
            second = int(check[b] & SECOND) if n else 0
            yield int(code[b : b + 1].view(np.int64)[0]), second, langs[rows[words.owner[i]]].as_py(), words.phrase(i, n) if n else b"", e - b


def _phrase_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _PHRASES)], schema=_PHRASES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _PHRASES)], schema=_PHRASES)


def _read_back(keyed: DataFrame, frequent: DataFrame, at: Settings) -> DataFrame:
    """The phrase behind each fingerprint, read from the text of the document that its row points to."""
    # A document has no more fingerprints than n-grams.
    wanted = frequent.groupBy("row").agg(F.collect_list("code").alias("codes"))

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    codes = np.sort(one.column(4).values.to_numpy().view(np.uint64))
                    for words, places, _ in _slices([one], at.bits):
                        yield from _spelled(words, places, one.column(3), at.longest, lambda c: codes[np.searchsorted(codes, c).clip(max=len(codes) - 1)] == c)

        yield from _phrase_batches(rows())

    found = keyed.join(wanted.hint("merge"), "row").select("row", "seed", "text", "lang", "codes").mapInArrow(run, PHRASES)
    # Blocks of a text and equal documents tell the same again; of clashing phrases any will do here.
    return found.groupBy("code").agg(F.min(F.struct("second", "lang", "phrase")).alias("p")).select("code", "p.*")


def _recounted(keyed: DataFrame, clashing: DataFrame, at: Settings) -> DataFrame:
    """lang, phrase, f of what shares a fingerprint with another phrase, counted by the phrase itself."""
    wanted = Bitmap(clashing, at.most_bits)

    def run(batches):
        def rows():
            for words, places, batch in _slices(batches, at.bits):
                yield from _spelled(words, places, batch.column(3), at.longest, wanted.holds)

        yield from _phrase_batches(rows())

    found = keyed.select("row", "seed", "text", "lang").mapInArrow(run, PHRASES)
    summed = found.groupBy("lang", "phrase", "code").agg(F.sum("f").alias("f")).join(clashing.select("code"), "code", "left_semi")
    return summed.where(F.col("f") >= at.least).select("code", "lang", "phrase", "f")


def frequent_phrases(docs: DataFrame, at: Settings = Settings()) -> DataFrame:
    """``lang``, ``size`` (words), ``phrase`` (joined by spaces), ``f`` of every phrase of up to ``longest`` words
    that occurs ``least`` times in its language, and the number of all words as that of size 0.

    ``docs`` has ``doc_id``, ``lang``, ``text``; other columns are not read. Null and empty texts have no
    words; a null language is ``und``; a repeated row counts again.
    """
    keyed = _keyed(docs)
    short = _counted(keyed, lambda w: [(0, w.at(1)), (1, w.at(1)), (2, w.at(2))][: at.longest + 1], at)
    pairs = short.where("code & 7 = 2")
    frequent = short
    if at.longest > 2:
        bitmap = Bitmap(pairs, at.most_bits)
        shared = docs.sparkSession.sparkContext.broadcast(bitmap)
        longest = at.longest
        frequent = short.unionByName(_counted(keyed, lambda w: _longer(w, shared.value, longest), at))
    found = stored(frequent.join(_read_back(keyed, frequent, at), "code", "left"), "phrases")
    sure = "sums = f * second"
    clashing = found.where(f"NOT coalesce({sure}, false)").select("code")
    told = found.where(sure).select("code", "lang", "phrase", "f")
    if not clashing.isEmpty():
        told = told.unionByName(_recounted(keyed, clashing, at))
    out = stored(
        told.selectExpr("lang", "cast(code & 7 AS int) AS size", "cast(phrase AS string) AS phrase", "f"), "phrases"
    )
    discard(found)
    return out


def collocations(docs: DataFrame, at: Settings = Settings()) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first ``top`` phrases.

    Rows are as ``frequent_phrases`` takes them. The score is that of the phrase's weakest cut, ties
    to the earliest; phrases that mostly occur inside a longer one are left out; order is by score,
    number and phrase. An empty table gives an empty one.
    """
    known = frequent_phrases(docs, at)
    words = known.where("size = 0").selectExpr("lang", "f AS n")
    phrases = known.where("size > 0").select("lang", "size", "phrase", "f")
    candidates = phrases.where("size > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).selectExpr(
        "*", "substring_index(phrase, ' ', k) AS head", "substring_index(phrase, ' ', k - size) AS tail"
    )
    parts = phrases.select("lang", "phrase", "f")
    scored = (
        cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"])
        .join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
        .withColumn("score", F.expr("(2000000BD * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + r)"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    # Runs of two words and more that lie inside a longer candidate, with the most frequent one around them.
    inside = candidates.where("size > 2").select(
        "lang", "a",
        F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), "
            "s -> array_join(slice(split(phrase, ' '), s, w), ' '))))"
        )).alias("phrase"),
    )
    around = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100BD * longer < {int(at.contained)}BD * a"
    )
    # The best of each of some parts of a language first, so that its last step has a set number of rows.
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    dealt = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= at.top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = ranked.where(F.col("rank") <= at.top)
    return best.join(words, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long")
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \\t]+') IF x <> ''] AS w FROM p
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, s, unnest([array_to_string(w[i : i + s - 1], ' ') FOR i IN range(1, len(w) - s + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS s)
), f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1
), k AS (
  SELECT lang, s, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, s)) AS k FROM c)
), t AS (
  SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, 2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS score,
         row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY 2000000 * CAST(a AS HUGEINT) // (x.f + y.f), k) AS i
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = tail
), u AS (
  SELECT lang, a, array_to_string(w[i : i + z - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, s - z + 2)) AS i FROM (SELECT *, unnest(range(2, s)) AS z FROM c))
), d AS (SELECT lang, phrase, max(a) AS longer FROM u GROUP BY ALL
), b AS (
  SELECT t.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM t LEFT JOIN d USING (lang, phrase) WHERE i = 1 AND (longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score FROM b JOIN n USING (lang) WHERE rank <= 2000
"""
