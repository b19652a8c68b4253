"""Quality by positive-unlabelled learning: the non-negative unbiased risk over dense text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import RollingHash, joined_bytes, short_batches, word_blocks
from riskweave.llm.labelled import held_out, in_slices, sample, slices, unlabelled_sample

SLICE = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
#: Bytes whose share of the text is a feature each: printable ASCII but letters, and line ends.
_SIGNS = [b for b in range(33, 127) if not _LETTER[b] and not _DIGIT[b]] + [10]
WIDTH = 16 + len(_SIGNS)


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _told(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the numbers of its bytes by value and sums over its words; the text and hash of every word."""
    data, bounds = joined_bytes([t + b"\n" for t in texts])
    n_docs, size = len(texts), np.diff(bounds)
    owner = np.repeat(np.arange(n_docs), size)
    counts = np.bincount(owner * 256 + data, minlength=n_docs * 256).reshape(n_docs, 256)
    counts[:, 10] -= 1
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    doc = owner[starts]
    length = (ends - starts).astype(np.float64)
    last = ~_LETTER[data[ends - 1]]
    values = [
        np.ones(len(doc)), length, length**2, _UPPER[data[starts]], last,
        last & ~_LETTER[data[np.maximum(ends - 2, starts)]], ~_LETTER[data[starts]], length > 20,
    ]
    sums = np.stack([np.bincount(doc, v, n_docs) for v in values], axis=1)
    hashes = RollingHash(data).of(starts, ends) if len(starts) else np.empty(0, np.uint64)
    return counts, sums, doc, hashes


def _long(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_told`` of one long text, block by block."""
    counts, sums, hashes = np.zeros((1, 256), np.int64), np.zeros((1, 8)), [np.empty(0, np.uint64)]
    for block in word_blocks(text, size):
        c, s, _, h = _told([block])
        counts, sums = counts + c, sums + s
        hashes.append(h)
    hashes = np.concatenate(hashes)
    return counts, sums, np.zeros(len(hashes), np.int64), hashes


def features(texts: list[bytes], slice: int = SLICE) -> np.ndarray:
    """One row of WIDTH numbers per whole text; a text without words has zeros but for its signs. A long
    text that comes alone is worked through block by block."""
    alone = len(texts) == 1 and len(texts[0]) > 2 * slice
    counts, sums, doc, hashes = _long(texts[0], slice) if alone else _told(texts)
    n_docs, size = len(texts), np.array([len(t) for t in texts])
    out = np.zeros((n_docs, WIDTH))
    letters, upper = counts[:, _LETTER].sum(1), counts[:, _UPPER].sum(1)
    out[:, 16:] = np.sqrt(_ratio(counts[:, _SIGNS], size[:, None]))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), _ratio(letters, size), _ratio(upper, letters)
    out[:, 3] = _ratio(counts[:, _DIGIT].sum(1), size)
    if not len(doc):
        return out
    words = sums[:, 0]
    means = _ratio(sums, words[:, None])
    out[:, 4], out[:, 5] = np.log1p(words), means[:, 1]
    out[:, 6] = np.sqrt(np.maximum(means[:, 2] - means[:, 1] ** 2, 0))
    out[:, 7:11] = means[:, 3:7]
    for at, span in ((11, 1), (12, 3)):
        if len(doc) < span:
            continue
        joined = hashes[: len(doc) - span + 1].copy()
        for k in range(1, span):
            joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(doc) - span + 1 + k]
        same = doc[: len(joined)] == doc[span - 1 :]
        joined, at_doc = joined[same], doc[: len(same)][same]
        order = np.lexsort((joined, at_doc))
        first = np.ones(len(joined), dtype=bool)
        first[1:] = (joined[order][1:] != joined[order][:-1]) | (at_doc[order][1:] != at_doc[order][:-1])
        out[:, at] = _ratio(np.bincount(at_doc[order][first], minlength=n_docs), np.bincount(at_doc, minlength=n_docs))
    out[:, 13] = _ratio(counts[:, 10], words)
    out[:, 14] = _ratio(counts[:, 46] + counts[:, 33] + counts[:, 63], words)
    out[:, 15] = means[:, 7]
    return out


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = np.clip((features(texts) - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def train(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 600, rate: float = 0.05, decay: float = 1e-4
) -> Model:
    """A linear model of the features that minimises the non-negative risk
    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]) with the logistic loss.

    Where the second part is negative, the step goes along its own slope instead, so that it does
    not fall further. Without positives or unlabelled rows, the score is the prior for every text.
    """
    width = positive.shape[1] if len(positive) else WIDTH
    prior = float(np.clip(prior, 0.01, 0.99))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(prior / (1 - prior))))
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = (np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = np.column_stack([p, np.ones(len(p))]), np.column_stack([u, np.ones(len(u))])
    w = np.zeros(width + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) for x in (p, u))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        rise = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        slope = -rise if negative < 0 else rise - prior * (p * (1 - sp)[:, None]).mean(0)
        slope[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(centre, scale, w[:-1], float(w[-1]))


def _table(texts: list[str]) -> np.ndarray:
    return np.concatenate([features(some) for _, some in slices([t.encode() for t in texts], SLICE)] or [np.zeros((0, WIDTH))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, chars: int = 12_000_000, piece: int = 60_000) -> Model:
    """Trusted positives, unlabelled documents and the class prior, each from bounded samples: at most ``rows``
    documents and ``chars`` characters, ``piece`` of a document at most.

    The prior is the smoothed share of quality 1 among labels that are not held out, over the
    whole table. Unlabelled texts are taken whatever their labels say.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    trusted = sample(docs, labels, "quality", rows, chars, piece)
    texts = trusted["text"][trusted["label"] == 1].tolist()
    web = unlabelled_sample(docs, rows, chars, piece)["text"].tolist()
    return train(_table(texts), _table(web), ((good or 0) + 1) / (n + 2))


def scored(text: Column, model: Model) -> Column:
    """The model's score of whole texts, 0 to 1; null counts as empty. A row's score follows from its text
    alone, so equal texts score the same and other columns do not matter."""

    short_batches()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(in_slices(batch, model.score, SLICE))

    return score(text)
