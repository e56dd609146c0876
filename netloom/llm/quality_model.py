"""Text quality by naive Bayes support vectors.

Features say whether a hashed n-gram occurs in a text: character n-grams (1 to 3, case and
punctuation kept), and n-grams (1 to 6) of the text's shape, in which runs of capitals, small
letters, digits and blanks are one sign each and a word equal to the one before it is another.
Each indicator is scaled by its class log-count ratio; a linear model with hinge loss is then
fitted by dual coordinate descent. A part of the sample that is left out of learning sets the
scale of the scores.

Whole texts are read in chunks of bounded size; a text's indicators are a row of 2^BITS flags.
The classifier is fitted on a bounded sample, about ``PER_LABEL`` documents per label.

Defined cases: an empty or null text scores as one without features. Null ids are scored, never
learned from. Without labels the score is 0. Extra columns stay; ``score`` is
replaced. Repeated rows are scored each; equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import ngrams
from netloom.llm.samples import fitted_sigmoid, sampled_texts, sigmoid

PER_LABEL = 1200
BITS = 15
CHARACTERS, SHAPES = (1, 2, 3), (1, 2, 3, 4, 5, 6)
#: Added to every count of a feature; bound of the dual variables; passes over the sample.
SMOOTHING, COST, PASSES = 1.0, 10.0, 20
#: Signs of the shape (fixed values, outside the text's own characters).
_UPPER, _LOWER, _DIGIT, _AGAIN = (np.uint32(0x110000 + i) for i in range(4))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for rows, flags in indicators(texts):
            out[rows] += flags @ self.weights
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.shift)


def _shape(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs of the text, one per run, and the place in ``codes`` where each run begins."""
    low = ngrams.lowered(codes)
    letter, digit, gap = ngrams.letters(codes), (codes >= 48) & (codes <= 57), ngrams.blank(codes)
    sign = np.where(letter, np.where(low != codes, _UPPER, _LOWER), codes)
    sign[digit], sign[gap] = _DIGIT, ngrams.SPACE
    begins = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    if len(begins) > 1:
        place = np.arange(len(codes)) - begins[np.maximum(np.searchsorted(begins, np.arange(len(codes)), "right") - 1, 0)]
        power = ((np.maximum(place, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
        term = np.where(gap, np.uint64(0), (low.astype(np.uint64) + np.uint64(7)) * power)
        word = np.add.reduceat(term, begins)
        again = np.concatenate([[False], word[1:] == word[:-1]])
        again[np.minimum(np.searchsorted(begins, starts), len(begins) - 1)] = False  # the first word of a text
        number = np.searchsorted(begins, np.arange(len(codes)), "right") - 1
        sign[(number >= 0) & again[np.maximum(number, 0)] & ~gap] = _AGAIN
    new = np.concatenate([[True], sign[1:] != sign[:-1]])
    new[starts] = True
    return sign[new], np.flatnonzero(new)


def indicators(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, flags): 2^(BITS + 1) flags for each row with text; a row comes once."""
    held: tuple[int, np.ndarray] | None = None
    for codes, starts, owners in ngrams.chunks(texts):
        rows, row_of_part = np.unique(owners, return_inverse=True)
        flags = np.zeros((len(rows), 2 << BITS), np.float32)
        flat = flags.reshape(-1)
        part = np.zeros(len(codes), np.int64)
        part[starts[1:]] = 1
        part = np.cumsum(part)
        base = row_of_part[part] * (2 << BITS)
        signs, places = _shape(codes, starts)
        for signs_, at, sizes, shift in ((codes, np.arange(len(codes)), CHARACTERS, 0), (signs, places, SHAPES, 1 << BITS)):
            for n in sizes:
                key = ngrams.hashed(signs_, n, BITS)
                own = part[at[: len(key)]] == part[at[n - 1 :][: len(key)]]  # no n-gram lies in two texts
                flat[(base[at[: len(key)]] + shift + key)[own]] = 1
        if held is not None:
            if rows[0] == held[0]:
                flags[0] = np.maximum(flags[0], held[1])
            else:
                yield np.array([held[0]]), held[1][None]
        held = (int(rows[-1]), flags[-1].copy())
        if len(rows) > 1:
            yield rows[:-1], flags[:-1]
    if held is not None:
        yield np.array([held[0]]), held[1][None]


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    """``labels`` 0 or 1. Every fifth document is left out of learning and sets the scale."""
    rng = np.random.default_rng(seed)
    features: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    for rows, flags in indicators(pa.array(texts)):
        for row, own in zip(rows, flags, strict=True):
            features[row] = np.flatnonzero(own).astype(np.int32)
    order = rng.permutation(len(texts))
    kept_back = order[::5] if len(order) >= 20 else order
    learned = np.setdiff1d(order, kept_back) if len(kept_back) < len(order) else order
    counts = np.full((2, 2 << BITS), SMOOTHING)
    for i in learned:
        counts[labels[i], features[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = np.where(labels == 1, 1.0, -1.0)
    valued = [ratio[f] for f in features]
    norm = np.array([v @ v + 1.0 for v in valued])
    scale = 1.0 / np.median(norm[learned])  # a document's length in features must not set the cost
    bound = COST * scale * len(learned) / 2 / np.maximum(np.bincount(labels[learned], minlength=2), 1)
    w, bias, dual = np.zeros(2 << BITS), 0.0, np.zeros(len(texts))
    for _ in range(PASSES):
        for i in rng.permutation(learned):
            own = features[i]
            gradient = sign[i] * (w[own] @ valued[i] + bias) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), bound[labels[i]])
            step = (new - dual[i]) * sign[i]
            if step:
                w[own] += step * valued[i]
                bias += step
                dual[i] = new
    model = Model((w * ratio).astype(np.float32), bias)
    model.slope, model.shift = fitted_sigmoid(model.margins(pa.array([texts[i] for i in kept_back])), labels[kept_back])
    return model


def trained(docs: DataFrame, labels: DataFrame, learn: F.Column, per_label: int = PER_LABEL) -> Model | None:
    """Learns from ``labels`` (doc_id, label) for which ``learn`` holds; None without both labels."""
    got = sampled_texts(docs, labels.where(learn), per_label)
    truth = np.array(got.column("label").to_pylist(), np.int64)
    if len(set(truth.tolist())) < 2:
        return None
    return fit(got.column("text").to_pylist(), truth)
