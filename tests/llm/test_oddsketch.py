"""Near-duplicates against all pairs of whole sets."""

import itertools
import random
import re

import numpy as np
import pytest

from riskweave.llm import oddsketch

DOCS = "doc_id long, text string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _set(text, words=4):
    found = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOWER))
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1))


def _brute(rows):
    sets = [(i, _set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    out = []
    for i, s in sets:
        component = find(i) if i is not None and s else i
        out.append((i, len(s), component, i is None or component == i))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, number = [], 10
    for family in range(12):
        base = prose(rng.randrange(20, 150))
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 30) + 1)):
                own[rng.randrange(len(own))] = "EDIT" + str(rng.randrange(99))
            rows.append((number, " ".join(own)))
            number += 1
    rows += [(500 + i, rows[0][1].upper()) for i in range(30)]  # copies
    rows += [(600, None), (601, ""), (602, " \n"), (603, "One two"), (604, "one\ttwo "), (605, "one two three"), (3, "one two")]
    rows += [(None, "one two"), (605, "one two three"), (607, " ".join(prose(20000)))]
    return rows


@pytest.mark.parametrize("at", [oddsketch.Settings(), oddsketch.Settings(block=6, codes=300, hubs=1, slice=200)])
def test_all_pairs(spark, at):
    rows = _rows()
    df = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "1 AS n", "'x' AS id")
    out = oddsketch.near_duplicates(df, at)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == _brute(rows)


def test_empty(spark):
    assert oddsketch.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_copies_of_one_text_make_no_pairs(spark):
    rows = [(i, "the same words in each of these many texts " * 3) for i in range(3000)]
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_sketches_estimate_the_similarity():
    at = oddsketch.Settings()
    for shared in (1000, 980, 900, 800):
        words = [f"a{i}" for i in range(1003)]
        other = words[:shared] + [f"b{i}" for i in range(1003 - shared)]
        texts = [" ".join(w).encode() for w in (words, other)]
        _, _, _, sketch = oddsketch.sketches_of(texts, at)
        a, b = (_set(t.decode()) for t in texts)
        differ = np.bitwise_count(sketch[0] ^ sketch[1]).sum()
        assert abs(oddsketch.similarity(differ, at) - len(a & b) / len(a | b)) < at.slack


def test_chains_are_followed_beyond_the_hubs(spark):
    """Each text is near the next one only, so most links are found in blocks."""
    words = [f"c{i}" for i in range(400)]
    rows = [((i * 37) % 101, " ".join(words[4 * i : 4 * i + 70])) for i in range(80)]
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, DOCS), oddsketch.Settings(block=8)).collect()
    assert sorted(map(tuple, out), key=repr) == _brute(rows)


@pytest.mark.parametrize("ids", [(1, 10, 11, 2), (1, 10, 11, 12, 13, 2), (1, 30, 31, 2, 32, 33, 3)])
def test_links_between_members_of_different_hubs(spark, ids):
    """A chain whose hubs are linked through members alone: each member is linked with some hub."""
    words = [f"d{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * k : 4 * k + 70])) for k, i in enumerate(ids)]
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, out), key=repr) == _brute(rows) and {r["component_id"] for r in out} == {1}


def test_long_texts_are_sliced_without_loss():
    rng = random.Random(3)
    text = "".join(rng.choice(["One", "two ", "three\n", "\t", " x ", "y", "long" * 9]) for _ in range(3000)).encode()
    for words in (1, 4, 5):
        for given in (text, text + b" " * 500, b" " * 500 + text, b"a" * 700, b"a b " * 2, b" " * 300):
            whole = oddsketch.shingles([given], words)[1].tolist()
            for size in (3, 50, 1000):
                assert oddsketch.long_shingles(given, words, size)[1].tolist() == whole
