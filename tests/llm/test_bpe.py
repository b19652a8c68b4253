"""Byte-level BPE against the library that the ranks are made for, and back again."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PAIRS = bpe.byte_pairs(PATH, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=PAIRS.ranks, special_tokens={})


def _ids(text):
    return np.frombuffer(PAIRS.encode(text), np.int32).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(text):
    ids = _ids(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert PAIRS.decode(ids) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "the", "日本", " ", "!?"])
def test_long_pre_tokens(letters):
    random.seed(4)
    for text in (letters * 20000, "".join(random.choice(letters) for _ in range(30000))):
        assert _ids(text) == LIBRARY.encode_ordinary(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    own = bpe.BytePairs(PATH, PATTERN)
    for i in range(50):
        own.encode(f"word{i} other{i * 7}")
    assert len(own.known) <= 20


def test_table(spark):
    texts = [None, "", "Hello  world\n", "<|endoftext|>", "é" * 5000, "Hello  world\n", "x" * 200000]
    rows = [(None if i == 4 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS decoded")
    got = {tuple(r) for r in bpe.digests(df, PATH, PATTERN).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = set()
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        expected.add((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())))
    assert got == expected
    both = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, bpe.round_trip(df, PATH, PATTERN).collect()))
    assert bpe.digests(df.where("false"), PATH, PATTERN).count() == 0


def test_any_order_of_ranks(tmp_path):
    """Also a token that ranks before its parts, and bytes whose pairs all have the same few ranks."""
    dice = random.Random(5)
    tokens = {bytes([b]) for b in range(256)}
    words = [bytes(dice.choice(b"abc") for _ in range(dice.randint(2, 7))) for _ in range(300)]
    tokens = dice.sample(sorted(tokens | set(words)), len(tokens | set(words)))
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = bpe.BytePairs(str(path), PATTERN)
    first, last = (own.byte_slots[t[0] << 8 | t[1]] for t in sorted((t for t in tokens if len(t) == 2), key=own.ranks.get)[:: max(1, sum(len(t) == 2 for t in tokens) - 1)])
    assert len(own.byte_slots) == 65536 and 65535 >= first > last >= 0  # the lowest rank on top
    library = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for _ in range(300):
        text = "".join(dice.choice("abc") for _ in range(dice.randint(1, 90)))
        assert np.frombuffer(own.encode(text), np.int32).tolist() == library.encode_ordinary(text)
    assert not any(own.groups)
