"""Phrases against a count of all n-grams."""

import random
import re
from collections import Counter

import pytest

from riskweave.llm import phrases

DOCS = "doc_id long, text string, lang string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _pieces(rows):
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            yield lang or "und", re.findall(r"[^ \t]+", piece)


def _counts(rows, longest=4):
    found, words = Counter(), Counter()
    for lang, piece in _pieces(rows):
        words[lang] += len(piece)
        for n in range(1, longest + 1):
            found.update((lang, tuple(piece[i : i + n])) for i in range(len(piece) - n + 1))
    return found, words


def _brute(rows, least, top):
    found, words = _counts(rows)
    frequent = {k: f for k, f in found.items() if len(k[1]) > 1 and f >= least}
    gone = set()
    for (lang, w), f in frequent.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * f >= 80 * found[lang, w[i : i + n]]:
                    gone.add((lang, w[i : i + n]))
    out = []
    for lang in words:
        ranked = []
        for (its, w), a in frequent.items():
            if its == lang and (its, w) not in gone:
                cuts = [(2000000 * a // (found[lang, w[:k]] + found[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(w).encode(), found[lang, w[:k]], found[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def _rows():
    rng = random.Random(12)
    vocabulary = ["New", "york", "city", "état", "the", "of", "a", "x", "日本", "b-c", "'tis"]
    rows = []
    for i in range(260):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            words[:0] = ["in", "new", "YORK", "city", "hall"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [(1, None, "en"), (2, "", "en"), (3, " \t.,", "en"), (None, "new york city", None), (None, "new york city", None), (0, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("bits", [61, 9])
def test_all_ngrams(spark, bits):
    """With nine bits nearly every fingerprint is shared, and counts come from the texts again."""
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", "1 AS row", "'x' AS code", "2 AS n", "'y' AS phrase")
    out = phrases.collocations(docs, phrases.Settings(least=5, top=40, bits=bits, most_bits=16))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == _brute(rows, 5, 40)


def test_frequent_phrases_are_whole_counts(spark):
    rows = _rows()
    out = phrases.frequent_phrases(spark.createDataFrame(rows, DOCS), phrases.Settings(least=5)).collect()
    found, words = _counts(rows)
    expected = {(lang, len(w), " ".join(w), f) for (lang, w), f in found.items() if f >= 5}
    expected |= {(lang, 0, "", n) for lang, n in words.items() if n >= 5}
    assert {tuple(r) for r in out} == expected and len(out) == len(expected)


def test_long_texts_are_parted_without_loss(spark, monkeypatch):
    """A long text in blocks counts as it does in one, with and without ends of pieces."""
    rng = random.Random(4)
    rows = [(1, " ".join(rng.choice("abcdef") for _ in range(4000)), "en"), (2, ". ".join("a b c d e f" for _ in range(500)), "en"), (3, "z" * 5000 + " a b", "en")]
    monkeypatch.setattr(phrases, "SLICE", 100)
    blocks = list(phrases._blocks(rows[0][1].encode()))
    assert len(blocks) > 50 and all(len(b) < 120 for b, _ in blocks)
    monkeypatch.setattr(phrases, "HELD", 50)
    found, _ = _counts(rows)
    for n in range(1, 5):
        counted = Counter()
        for _, text, _ in rows:
            for block, known in phrases._blocks(text.encode()):
                words = phrases.Words([block], phrases.np.zeros(1, "uint64"), phrases.np.array([known]), 61)
                counted.update(tuple(words.phrase(i, n).decode().split(" ")) for i in words.at(n))
        assert counted == Counter({w: f for (_, w), f in found.items() if len(w) == n})


def test_arithmetic_passes_64_bits(spark):
    """The score's product of a count near 2**62."""
    assert spark.sql("SELECT (2000000BD * cast(4611686018427387904L AS decimal(20,0))) div (cast(4611686018427387904L AS decimal(20,0)) + 4611686018427387905L) AS s").first()[0] == 999999


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOCS)).collect() == []
