"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its hash and its byte n-grams, with a space at either end; every one has an embedding
in a hashed table, so a misspelling or an unseen ending shares most of its vectors. The bag of a
few neighbouring words is averaged and goes through a linear softmax. A document scores as its
most toxic bag, so a long text does not hide an insult.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import RollingHash, joined_bytes, short_batches
from riskweave.llm.labelled import in_slices, sample, slices

GRAMS = (3, 4, 5)
BITS = 17
WINDOW = 8
#: A bag is averaged over so many vectors at least, missing ones being zero, so that a lone word is no extreme.
LEAST = 96
#: Bytes of text that are scored at once.
SLICE = 1 << 18
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and bag of every subword, and the document of every bag. Bags count through the texts;
    a text without words has none."""
    data, bounds = joined_bytes([b" " + t + b" " for t in texts])
    data = _FOLD[data]
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not len(starts):
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    in_doc = (np.arange(len(starts)) - first[doc]) // WINDOW
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (in_doc[1:] != in_doc[:-1])
    bag = np.cumsum(new) - 1
    word_of = np.cumsum(np.concatenate([[0], ((~space[1:]) & space[:-1]).astype(np.int64)])) - 1
    inner = np.cumsum(space, dtype=np.int64)
    wide = data.astype(np.uint64)
    mask = np.uint64((1 << BITS) - 1)
    hashes = RollingHash(data).of(starts, ends)
    # A word repeated at once says nothing new.
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | new[1:]
    ids, bags = [(hashes[fresh] & mask).astype(np.uint32)], [bag[fresh]]
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | wide[k : len(data) - n + 1 + k]
        # No white space inside; at the ends it marks the ends of a word.
        ok = np.flatnonzero(inner[n - 2 : len(data) - 1][: len(code)] == inner[: len(code)])
        word = word_of[ok + 1]
        ok, word = ok[fresh[word]], word[fresh[word]]
        code = code[ok] * np.uint64(0x9E3779B97F4A7C15)
        ids.append((code >> np.uint64(64 - BITS)).astype(np.uint32))
        bags.append(bag[word])
    return np.concatenate(ids), np.concatenate(bags), doc[new]


def bag_blocks(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A long text in blocks of about ``size`` bytes whose bags are those of the whole text: all but the
    last have a multiple of WINDOW words. Eight words that are longer than a block stay together."""
    at, most = 0, size
    while at < len(text):
        end = len(text)
        if end - at > most:
            space = _FOLD[np.frombuffer(text, dtype=np.uint8, count=most, offset=at)] == 32
            starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            whole = (len(starts) - 1) // WINDOW * WINDOW if len(starts) else 0
            if not whole:
                most *= 2
                continue
            end = at + int(starts[whole])
        yield text[at:end]
        at, most = end, size


@dataclass
class Model:
    """One number per bucket, the difference of the two classes' logits, and its bias: a linear
    softmax over averaged embeddings is the average of these numbers."""

    buckets: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the toxic class per text; without words that of an empty bag."""
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE:
            return np.max([self._scored([block]) for block in bag_blocks(texts[0])], axis=0)
        return self._scored(texts)

    def _scored(self, texts: list[bytes]) -> np.ndarray:
        logits = np.full(len(texts), self.bias)
        ids, bags, doc = features(texts)
        if len(doc):
            n = np.maximum(np.bincount(bags, minlength=len(doc)), LEAST)
            mean = np.bincount(bags, weights=self.buckets[ids], minlength=len(doc)) / n + self.bias
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            logits[doc[first]] = np.maximum.reduceat(mean, first)
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets sorted by bag, number of them per bag, document per bag; some bytes of text at a time, to
    bound the memory. The buckets go straight into one array: parts joined at the end would be held twice."""
    ids = np.empty(sum(len(t) + 2 for t in texts) * (len(GRAMS) + 1), np.uint32)  # its unused end takes no memory
    sizes, docs, end = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for at, some in slices(texts, SLICE):
        part, bags, doc = features(some)
        ids[end : end + len(part)] = part[np.argsort(bags, kind="stable")]
        end += len(part)
        sizes.append(np.bincount(bags, minlength=len(doc)))
        docs.append(doc + at)
    return ids[:end], np.concatenate(sizes), np.concatenate(docs)


def train(
    texts: list[bytes], labels: np.ndarray, dim: int = 8, rounds: int = 12, epochs: int = 3, least: int = 3, seed: int = 7
) -> Model:
    """Embeddings and softmax weights, trained together by Adagrad over bags.

    Only buckets that occur in ``least`` documents or more learn, as rare ones would be learned by
    heart. The first coordinate starts at a bucket's log odds between the classes' documents, the
    others at random. Most bags of a toxic document are ordinary prose, so each round takes from a
    toxic document its bags near its best score, and from a clean one its worst bags and some
    others. With one class only, the model is that class's smoothed share.
    """
    labels = np.asarray(labels, dtype=np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    ids, sizes, doc = _bags(texts)
    if len(set(labels[doc].tolist())) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    found = np.zeros((2, 1 << BITS))
    for number, low, high in zip(doc[first], begin[first], begin[np.append(first[1:], len(doc))]):
        found[labels[number], np.unique(ids[low:high])] += 1
    docs = np.bincount(labels[np.unique(doc)], minlength=2)
    odds = np.log((found[1] + 1) / (docs[1] + 2)) - np.log((found[0] + 1) / (docs[0] + 2))
    learns = found.sum(0) >= least
    table = rng.uniform(-0.05, 0.05, (1 << BITS, dim))
    table[:, 0] = odds
    table[~learns] = 0
    weights = rng.normal(0, 0.1, (dim, 2))
    weights[0], bias = (-2.0, 2.0), np.array([2.0, -2.0])
    grown = [np.full(table.shape, 1e-6), np.full(weights.shape, 1e-2), np.full(2, 1e-2)]

    def model() -> Model:
        return Model((table @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))

    bags_of = np.diff(np.append(first, len(doc)))
    truth = labels[doc]
    for _ in range(rounds):
        buckets = model().buckets
        parts = np.array_split(np.arange(len(doc)), max(1, len(doc) // 4096))
        logit = [np.add.reduceat(buckets[ids[begin[p[0]] : begin[p[-1] + 1]]], begin[p] - begin[p[0]]) for p in parts]
        logit = np.concatenate(logit) / np.maximum(sizes, LEAST)
        best = np.repeat(np.maximum.reduceat(logit, first), bags_of)
        by_score = np.lexsort((-logit, doc))
        rank = np.empty(len(doc), dtype=np.int64)
        rank[by_score] = np.arange(len(doc)) - np.repeat(first, bags_of)
        near = (truth == 1) & ((rank == 0) | (logit >= best - 2) & (logit > -bias[1] + bias[0] - 1) & (rank < 20))
        used = np.flatnonzero(near | (truth == 0) & ((rank < 4) | (rng.random(len(doc)) < 0.1)))
        for _ in range(epochs):
            shuffled = rng.permutation(len(used))
            for part in np.array_split(shuffled, max(1, len(used) // 256)):
                rows = used[part]
                flat, count = np.concatenate([ids[begin[b] : begin[b + 1]] for b in rows]), sizes[rows]
                n = np.maximum(count, LEAST)
                hidden = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(count)[:-1]]), axis=0) / n[:, None]
                error = hidden @ weights + bias
                error = np.exp(error - error.max(1, keepdims=True))
                error /= error.sum(1, keepdims=True)
                error[np.arange(len(rows)), truth[rows]] -= 1
                error /= len(rows)
                back = np.repeat((error @ weights.T) / n[:, None], count, axis=0)
                touched, where = np.unique(flat, return_inverse=True)
                slope = np.column_stack([np.bincount(where, back[:, k], len(touched)) for k in range(dim)])
                slope *= learns[touched, None]
                rise = hidden.T @ error
                grown[1] += rise**2
                weights -= 0.05 * rise / np.sqrt(grown[1])
                rise = error.sum(0)
                grown[2] += rise**2
                bias -= 0.05 * rise / np.sqrt(grown[2])
                grown[0][touched] += slope**2
                table[touched] -= 0.1 * slope / np.sqrt(grown[0][touched])
    return model()


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1500, chars: int = 4_000_000, piece: int = 60_000) -> Model:
    """A model from at most ``rows`` documents and ``chars`` characters a class, ``piece`` of a document at
    most (see ``sample``)."""
    learned = sample(docs, labels, "toxic", rows, chars, piece)
    texts, truth = [t.encode() for t in learned["text"]], learned["label"].to_numpy(np.int64)
    del learned
    return train(texts, truth)


def scored(text: Column, model: Model) -> Column:
    """The model's score of whole texts, 0 to 1; null and empty texts score as an empty bag. A row's score
    follows from its text alone, so equal texts score the same and other columns do not matter."""

    short_batches()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(in_slices(batch, model.score, SLICE))

    return score(text)
