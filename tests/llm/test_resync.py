"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece

from riskweave.llm import resync

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts():
    rng = random.Random(13)
    words = ["the", "quick", "naïve", "日本語", "𠀀𠀁", "<s>", "</s>", "<unk>", "▁x", "\x00", "12345", "é", "　", "ﬁ", "internationalization"]
    texts = [None, "", " ", "  ", "\n", "a", "▁", "<0x41>"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", "\t", "\n\n"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    texts += ["a" * n for n in (100, 997, 5000)] + ["ab" * 700, " " * 3000, "é" * 900, "日" * 800, "\U0010ffff" * 300, "." * 2500, "=-" * 900]
    return texts + ["x" + " " * 1500 + "y" * 1500, "".join(rng.choice("abcdefgh") for _ in range(4000))]


@pytest.mark.parametrize("at", [resync.Chunks(), resync.Chunks(60, 12, 2), resync.Chunks(7, 3, 3)])
def test_whole_texts(spark, model, at):
    texts = _texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (20, texts[20]), (20, texts[21])]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).selectExpr("*", "1 AS key", "2 AS part", "'n' AS n_tokens")
    out = resync.token_counts(docs, PATH, 300, at)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 300) for i, t in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)


def test_joined_tokens_are_those_of_the_text(model):
    """Every place where two chunks agree is a border of the whole text's tokens."""
    pieces, rng = resync.pieces(PATH), random.Random(7)
    for text in filter(None, _texts()):
        whole = set(pieces.ends(text).tolist())
        for _ in range(6):
            cut = rng.randrange(len(text))
            first, second = text[: cut + 40], text[cut:]
            before = resync.marked_size(text[:cut])
            tail, head = pieces.ends(first), pieces.ends(second)
            tail = tail[tail >= before] - before
            at = resync.splice(tail, head)
            if at:
                assert int(tail[at[0] - 1]) + before in whole


def test_chunks_widen_until_they_agree(spark, model):
    """Runs in which chunks keep to their own rhythm need longer overlaps, here the whole text."""
    text = "ab" + "a" * 3001
    docs = spark.createDataFrame([("k", text)], "key string, text string")
    at = resync.Chunks(100, 10, 2)
    once = resync._joined(resync._encoded(resync._cut(docs, at), PATH, at)).first()["n_tokens"]
    assert once is None
    assert resync.long_counts(docs, PATH, at).first()["n_tokens"] == len(model.encode(text))


def test_a_long_text_is_many_tasks(spark):
    text = " ".join(f"word{i}" for i in range(40000))
    cut = resync._cut(spark.createDataFrame([("k", text), ("k", text)], "key string, text string"), resync.Chunks())
    parts = cut.collect()
    assert len(parts) == len({r["part"] for r in parts}) > 8 and max(len(r["text"]) for r in parts) <= (1 << 15) + 512


def test_other_models_are_refused(monkeypatch):
    class Folding:
        def __init__(self, **_):
            pass

        def normalize(self, text):
            return text.lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="leaves the text"):
        resync.Pieces("any")


def test_empty(spark):
    assert resync.token_counts(spark.createDataFrame([], DOCS), PATH).collect() == []
