"""Held-out accuracy of the two classifiers, their bounds, and rows that lack something."""

import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import common, labelled, quality, queries, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.01")


def _judged(spark, query, label, sf=SF):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = query(spark, sf).join(labels, "doc_id").where("held_out").collect()
    return [(r[label], r["predicted"], r["score"]) for r in rows]


def test_toxicity_on_held_out_documents(spark):
    """On the larger table, as the smaller one has some twenty toxic documents to learn from."""
    rows = _judged(spark, queries.op2_toxicity, "toxic", SF.replace("sf0.01", "sf0.1"))
    toxic, clean = [p for y, p, _ in rows if y], [p for y, p, _ in rows if not y]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_quality_on_held_out_documents(spark):
    rows = _judged(spark, queries.op9_quality, "quality")
    good, bad = [p for y, p, _ in rows if y], [p for y, p, _ in rows if not y]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_held_out_is_the_remainder_of_crc32(spark):
    rows = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_unseen_endings_share_ngrams():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeiourtnsl"), 6))
    prose = lambda: [word() for _ in range(60)]
    texts, labels = [], []
    for i in range(300):
        words = prose()
        if i % 3 == 0:
            for _ in range(3):
                words[rng.integers(60)] = "zquag" + word()
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels))
    new = [" ".join(prose() + ["zquagxxyy", "zquagh"] + prose()).encode() for _ in range(20)]
    assert (model.score(new) >= 0.3).mean() > 0.9
    assert (model.score([" ".join(prose()).encode() for _ in range(100)]) >= 0.3).mean() < 0.05


@pytest.mark.parametrize("module", [toxicity, quality])
def test_rows_that_lack_something(spark, module):
    docs = spark.createDataFrame(
        [(i, t, 1.0) for i, t in enumerate([None, "", " \n", "word", "a b c " * 20000, "word"])] + [(None, "x", 1.0)], "doc_id long, text string, score double"
    )
    labels = spark.createDataFrame([(3, 1, 1), (5, None, None), (4, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false"), labels.where("doc_id = 3")):
        model = module.fit(docs, known)
        rows = docs.select("doc_id", module.scored(F.col("text"), model).alias("s")).collect()
        assert len(rows) == 7 and all(0 <= r["s"] <= 1 for r in rows)
    none = docs.where("false")
    assert none.select(module.scored(F.col("text"), module.fit(none, labels))).collect() == []


def test_samples_are_bounded_and_leave_held_out_labels_alone(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('abcd ', 20) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    assert len(labelled.sample(docs, labels, "toxic", 30, 10**6, 60_000)) == 60
    assert len(labelled.sample(docs, labels, "toxic", 1000, 1000, 60_000)) == 20
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(labelled.sample(docs, labels, "toxic", 1000, 10**6, 60_000)) == 400 - len(out)


def test_a_long_text_keeps_no_other_out_of_a_sample(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('abcd ', 20) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    first = labels.where(~labelled.held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).orderBy("h").first()["doc_id"]
    docs = docs.selectExpr("doc_id", f"IF(doc_id = {first}, repeat('long ', 100000), text) AS text")
    whole = len(labelled.sample(docs, labels, "toxic", 1000, 10**6, 60_000))
    learned = labelled.sample(docs, labels, "toxic", 1000, 200_000, 60_000)
    assert len(learned) == whole and learned["text"].str.len().max() == 60_000
    assert len(labelled.unlabelled_sample(docs, 1000, 200_000, 60_000)) == 400
    # A class whose chosen ids have no text is chosen again.
    labels = labels.unionByName(spark.range(1000, 40000).selectExpr("id AS doc_id", "1 AS toxic"))
    assert labelled.sample(docs, labels, "toxic", 1, 10**6, 60_000)["label"].tolist() == [0, 1]


def test_risk_is_not_negative():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (400, 3))
    model = quality.train(good[:200], np.concatenate([good[200:], bad]), 1 / 3)
    score = lambda x: 1 / (1 + np.exp(-((x - model.centre) / model.scale @ model.weights + model.bias)))
    assert (score(good) > 0.5).mean() > 0.9 and (score(bad) < 0.5).mean() > 0.9


def _plain_bags(text):
    """Buckets of each bag of a text, word by word."""
    words, out = re.findall(rb"[^\x20\x09-\x0d]+", text.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))), []
    for first in range(0, len(words), toxicity.WINDOW):
        bag, before = [], None
        for word in words[first : first + toxicity.WINDOW]:
            if word != before:
                data = np.frombuffer(word, dtype=np.uint8)
                bag.append(int(common.RollingHash(data).of(np.array([0]), np.array([len(data)]))[0]) % (1 << toxicity.BITS))
                padded = b" " + word + b" "
                for n in toxicity.GRAMS:
                    for at in range(len(padded) - n + 1):
                        code = int.from_bytes(bytes([n]) + padded[at : at + n], "big") % 2**64
                        bag.append(code * 0x9E3779B97F4A7C15 % 2**64 >> (64 - toxicity.BITS))
            before = word
        out.append(sorted(bag))
    return out


def _texts():
    rng = np.random.default_rng(6)
    words = ["Bad", "bad", "é日", "x", "\t", "\n\n", "3.5!", "some-what", "ZZZ"]
    return [" ".join(rng.choice(words, rng.integers(0, 60))).encode() for _ in range(40)] + [b"", b" ", b"a", b"  a a a  b"]


def test_toxicity_features_and_scores_word_by_word():
    texts = _texts()
    ids, bags, doc = toxicity.features(texts)
    for i, text in enumerate(texts):
        own = [sorted(ids[bags == b].tolist()) for b in np.flatnonzero(doc == i)]
        assert own == _plain_bags(text)
    model = toxicity.Model(np.random.default_rng(3).normal(0, 9, 1 << toxicity.BITS).astype(np.float32), -1.5)
    for text, score in zip(texts, model.score(texts)):
        logits = [float(model.buckets[b].sum(dtype=np.float64)) / max(len(b), toxicity.LEAST) - 1.5 for b in _plain_bags(text)]
        assert abs(score - 1 / (1 + np.exp(-max(logits, default=-1.5)))) < 1e-5


def test_long_texts_score_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(8)
    text = b" \n".join([t for t in _texts() if t] * 5) + b"  "
    model = toxicity.Model(rng.normal(0, 9, 1 << toxicity.BITS).astype(np.float32), -1.5)
    whole = model._scored([text])
    for size in (10, 100, 1000):
        blocks = list(toxicity.bag_blocks(text, size))
        assert b"".join(blocks) == text and len(blocks) > 2
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert model.score([text]) == whole
        assert np.allclose(quality.features([text], size), quality.features([text]), rtol=1e-12, atol=0)


@pytest.mark.parametrize(
    "call",
    [
        "from riskweave.llm import toxicity as m; import numpy as np; m.Model(np.zeros(1 << m.BITS, np.float32), 0.0).score([text])",
        "from riskweave.llm import quality as m; m.features([text])",
        "from riskweave.llm import oddsketch as m; m.sketches_of([text], m.Settings())",
        "from riskweave.llm import suffixes as m; [0 for _ in m.long_samples(text, m.Lengths())]",
    ],
)
def test_one_text_of_32_mb_in_bounded_memory(call):
    """A text that is sixty times a slice takes some hundred MB of a process, its own size included."""
    code = f"import random, resource; r = random.Random(1); text = b' '.join(b'%x' % r.randrange(1 << 40) for _ in range(3_100_000)); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; {call}; print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True).stdout.split()
    assert int(out[0]) > 32 << 20 and int(out[1]) < 700
