"""Repeated strings against a count of all strings."""

import collections
import hashlib
import random

import pytest

from riskweave.llm import suffixes

DOCS = "doc_id long, text string"


def _brute(rows, length):
    counts, texts = collections.Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        counts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abé \n") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(100):
        parts = []
        for _ in range(rng.randrange(9)):
            at = rng.randrange(300)
            parts.append(rng.choice(base)[at : at + rng.randrange(10, 100)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(6))))
        rows.append((i, "".join(parts)))
    # Null and short texts, a text that repeats itself, equal rows, one id with two texts, no id, a shared line.
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "a" * 39), (204, rows[5][1]), (5, rows[5][1]), (None, rows[7][1]), (205, "ab" * 200)]
    return rows + [(300 + i, f"{i * 7919:06d}" + base[0][:60] + f"{i * 104729:08d}" * 5) for i in range(40)]


@pytest.mark.parametrize("most", [32768, 8])
def test_all_strings(spark, most):
    rows = _rows()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = suffixes.digests(df, suffixes.Lengths(40, 17, most)).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, 40)


def test_default_lengths_and_edges(spark):
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(420))
    rows = [(1, "x" + passage[:200] + "y"), (2, passage[:200]), (3, passage[1:200] + "é"), (4, passage[100:300]), (5, passage[99:299] + "é"), (6, None)]
    got = suffixes.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, 200)
    assert suffixes.digests(spark.createDataFrame([], DOCS)).collect() == []


def test_documents_keep_columns_and_whole_characters(spark):
    passage = "é" * 30
    rows = [(1, "a" + passage + "b", "n"), (2, "cd" + passage, "n"), (3, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string").selectExpr("*", "99L AS n_chars", "'z' AS row")
    out = {r["doc_id"]: r for r in suffixes.without_repeats(df, suffixes.Lengths(41, 20)).collect()}
    assert list(out[1].asDict()) == ["doc_id", "text", "first", "n_chars", "row"]
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == ("ab", "cd", None)
    assert (out[1]["n_chars"], out[3]["n_chars"], out[1]["first"], out[1]["row"]) == (2, None, "n", "z")


def test_long_texts_are_sliced_without_loss():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcd ") for _ in range(300))
    text = ("".join(rng.choice("abcdefgh ") for _ in range(3000)) + passage + "z" * 700 + passage).encode()
    _, place, rank, hull = suffixes.samples([text], suffixes.Lengths(40, 17))
    for size in (25, 64, 1000, 9000):
        parts = [suffixes.np.concatenate(c) for c in zip(*suffixes.long_samples(text, suffixes.Lengths(40, 17, slice=size)))]
        assert sorted(zip(*[p.tolist() for p in parts])) == sorted(zip(place.tolist(), rank.tolist(), hull.tolist()))


def test_long_texts(spark, monkeypatch):
    """All texts through slices, and large groups through rounds of doubling, on ordinary rows."""
    rows = _rows()
    rounds, doubled = [], suffixes._doubled
    monkeypatch.setattr(suffixes, "_doubled", lambda *a: rounds.append(1) or doubled(*a))
    found = suffixes.digests(spark.createDataFrame(rows, DOCS).repartition(5), suffixes.Lengths(40, 17, 8, 30)).collect()
    assert sorted(map(tuple, found), key=repr) == _brute(rows, 40) and len(rounds) > 2


def test_removed_runs():
    text = bytes(100)
    assert suffixes.removed(text, [50, -5, 8, 95], [55, 2, 9, 99], 10) == [(0, 19), (50, 65)]
    assert suffixes.removed(text, [], [], 10) == [] and suffixes.left_over(b"abcdef", [(0, 1), (3, 5)]) == b"bcf"
