"""Mixing: targets against iterated resharing, prefix cuts against a plain loop, the texts of the mix."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from riskweave.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _targets(sizes, weights=(5, 2, 1), most=3):
    """By the rule as told: share by weight, limit, reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    limited, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in limited]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**share, **limited}
        for s in over:
            limited[s] = most * sizes[s]
            left -= limited[s]


def _mixed(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return mixing.mix(docs, **options).collect()


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 1}, {"z": 0, "y": 7, "x": 0}, {"a": 100, "b": 100, "c": 100, "d": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_cut_at_the_budget_in_hash_order(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, (i * 37) % 50) for i in range(2000)] + [(5, "b", 40), (5, "b", 40)]
    out = _mixed(spark, rows, rows_per_range=16, ranges_per_block=4)
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((i, n) for i, _, n in rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    expected = []
    for s, target in _targets(sizes).items():
        epochs, rest = divmod(math.floor(target + 1e-9), sizes[s])
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, t, n in rows if t == s)
        for _, i, n in own:
            expected.append((i, n, epochs * n + max(0, min(n, rest))))
            rest -= n
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in out) == sorted(expected)
    assert sorted(map(tuple, out)) == sorted(map(tuple, _mixed(spark, rows, rows_per_range=100)))


def test_one_source_holds_most_rows(spark):
    rows = [(i, "big" if i % 10 else f"s{i}", 3) for i in range(1000)]
    out = _mixed(spark, rows, rows_per_range=8)
    by_source = {}
    for r in out:
        by_source.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken - target) <= 1 for taken, target in by_source.values())


def test_empty_nulls_and_clashing_columns(spark):
    assert _mixed(spark, []) == []
    rows = [(None, None, None, 1, "x"), (1, "a", 5, 2, "y"), (1, "a", 5, 2, "y"), (2, "a", None, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, taken long, part string")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "size", "part", "source_size", "target", "epochs", "taken"]
    assert sorted(r["part"] for r in out.collect()) == ["x", "y", "y", "z"]


def test_words(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", " a  b\u00a0c\nd ", "é\u2003x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    for r in df.collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))


def test_mixed_documents_hold_what_is_taken(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 9)), "en", "ab"[i % 5 == 0], 0) for i in range(60)]
    rows += [(100, None, "en", None, 0), (101, "x " * 3000, "en", "c", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(docs, rows_per_range=4).collect()
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(sized, rows_per_range=4).collect()}
    texts = {r[0]: r[1] for r in rows}
    got = {}
    for r in out:
        words = r["text"].split()
        assert texts[r["doc_id"]].split()[: len(words)] == words and words
        assert r["n_chars"] == len(r["text"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
    assert got == {i: n for i, n in taken.items() if n}
