"""Toxicity of a text by subword-bag embeddings and a linear softmax.

A bag is 8 consecutive words: the average embedding of the hashed character n-grams (3 to 5)
of its words, their ends marked by a space. A linear softmax over the average tells toxic from
clean bags; embeddings and softmax are trained together in numpy. A misspelled word that was
never seen shares most n-grams, and so most of its vector, with the word it stands for.

Labels are per document, so learning has two passes: first every bag takes its document's label,
then a toxic document teaches by its most toxic bags only and a clean one by its least clean.
A document's margin is that of its most toxic bag - a few words count as much in a long text as
in a short one - and a part of the sample that is left out of learning sets the scale of the scores.

Both layers are linear in a bag, so scoring needs one number per n-gram key: a gather per
n-gram over the whole text and sums of blocks of 4 words.

The classifier is fitted on a bounded sample, about ``PER_LABEL`` documents per label.

Defined cases: an empty or null text scores as an empty bag. Null ids are scored, never learned
from; held_out is then false. Without labels the score is 0. Extra columns stay; ``score`` is
replaced. Repeated rows are scored each; equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import ngrams
from netloom.llm.common import add_columns, fields
from netloom.llm.samples import fitted_sigmoid, sampled_texts, sigmoid

PER_LABEL = 900
BITS = 18
SIZES = (3, 4, 5)
DIMENSIONS = 8
BLOCK = 4
#: Passes over the sample with documents' labels, then turns of passes over chosen bags, each from new vectors.
EPOCHS, TURNS = (2, 3), 2
RATE = 0.5
BATCH = 256
#: Bags of a document in the first pass, at most, and of its extreme ones in the second.
BAGS, EXTREME = 24, 4


@dataclass
class Model:
    value: np.ndarray  # per key: its embedding along the difference of the two classes
    bias: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        for codes, starts, owners in ngrams.chunks(texts):
            keys, blocks, owner_of = blocked(codes, starts, owners)
            total = np.zeros(len(owner_of))
            count = np.zeros(len(owner_of))
            for own in keys:
                at = blocks[: len(own)]
                total += np.bincount(at, self.value[own], len(owner_of))
                count += np.bincount(at, own > 0, len(owner_of))
            same = owner_of[1:] == owner_of[:-1]
            total[:-1] += total[1:] * same
            count[:-1] += np.where(same, count[1:], 0)
            np.maximum.at(best, owner_of, total / np.maximum(count, 1) + self.bias)
        return np.where(np.isinf(best), self.bias, best)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.shift)


def blocked(codes: np.ndarray, starts: np.ndarray, owners: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys at each place per size (0: none); the block each place lies in; the row of each block."""
    low = ngrams.lowered(codes)
    gaps = ngrams.blank(low)
    low = np.where(gaps, np.uint32(ngrams.SPACE), low)
    keys = [np.where(ngrams.inside_word(gaps, n), ngrams.hashed(low, n, BITS), 0) for n in SIZES]
    begins = gaps[:-1] & ~gaps[1:]
    word = np.concatenate([np.cumsum(begins), [0]])
    word[-1] = word[-2] if len(word) > 1 else 0
    part = np.zeros(len(codes), np.int64)
    part[starts[1:]] = 1
    part = np.cumsum(part)
    block = (np.maximum(word - word[starts][part], 0)) // BLOCK
    sizes = np.zeros(len(starts), np.int64)
    np.maximum.at(sizes, part, block + 1)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return keys, first[part] + block, np.repeat(owners, sizes)


class Trainer:
    """Embeddings and softmax, trained together by Adagrad on batches of bags."""

    def __init__(self, seed: int = 3) -> None:
        self.rng = np.random.default_rng(seed)
        self.embedding = ((self.rng.random((1 << BITS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
        self.layer = ((self.rng.random((DIMENSIONS, 2)) - 0.5) / DIMENSIONS).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen_e, self.seen_l, self.seen_b = np.full(1 << BITS, 1e-3, np.float32), np.full((DIMENSIONS, 2), 1e-3), np.full(2, 1e-3)

    def learn(self, bags: list[np.ndarray], labels: np.ndarray) -> None:
        order = self.rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            sizes = np.array([len(bags[j]) for j in at])
            keys = np.concatenate([bags[j] for j in at])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(self.embedding[keys], first, axis=0) / sizes[:, None]
            logits = mean @ self.layer + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1
            p /= len(at)
            g_layer, g_bias, g_mean = mean.T @ p, p.sum(axis=0), p @ self.layer.T
            distinct, place = np.unique(keys, return_inverse=True)
            each = np.repeat(g_mean / sizes[:, None], sizes, axis=0)
            g_keys = np.stack([np.bincount(place, each[:, d], len(distinct)) for d in range(DIMENSIONS)], axis=1)
            self.seen_l += g_layer**2
            self.layer -= RATE * g_layer / np.sqrt(self.seen_l)
            self.seen_b += g_bias**2
            self.bias -= RATE * g_bias / np.sqrt(self.seen_b)
            self.seen_e[distinct] += (g_keys**2).mean(axis=1) * 1e4
            self.embedding[distinct] -= RATE * 1e2 * g_keys / np.sqrt(self.seen_e[distinct])[:, None]

    def model(self) -> Model:
        value = (self.embedding @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)
        value[0] = 0
        return Model(value, float(self.bias[1] - self.bias[0]), 1.0, 0.0)


def _bags(texts: pa.Array) -> list[list[np.ndarray]]:
    """Of each text, the keys of its bags of two blocks."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for codes, starts, owners in ngrams.chunks(texts):
        keys, blocks, owner_of = blocked(codes, starts, owners)
        flat = np.concatenate(keys)
        at = np.concatenate([blocks[: len(k)] for k in keys])[flat > 0]
        flat = flat[flat > 0]
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(len(owner_of) + 1))
        flat = flat[order]
        for b, row in enumerate(owner_of):
            last = b + 2 if b + 1 < len(owner_of) and owner_of[b + 1] == row else b + 1
            if edges[last] > edges[b]:
                out[row].append(flat[edges[b] : edges[last]])
    return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 3) -> Model:
    """``labels`` 0 or 1. Every fifth document is left out of learning and sets the scale."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept_back = np.sort(order[::5]) if len(order) >= 20 else order
    learned = np.setdiff1d(order, kept_back) if len(kept_back) < len(order) else order
    bags = _bags(pa.array([texts[i] for i in learned]))
    truth = labels[learned]
    chosen, of = [], []
    for own, label in zip(bags, truth, strict=True):
        picked = rng.permutation(len(own))[:BAGS]
        chosen += [own[i] for i in picked]
        of += [label] * len(picked)
    trainer = Trainer(seed)
    for _ in range(EPOCHS[0]):
        trainer.learn(chosen, np.array(of))
    for turn in range(TURNS):
        # What the last model learned from wrongly labelled bags goes with it; its choice of bags stays.
        last, trainer = trainer.model(), Trainer(seed + turn + 1)
        ranked = [np.argsort([-last.value[k].mean() for k in own]) for own in bags]
        for _ in range(EPOCHS[1]):
            chosen, of = [], []
            for own, label, rank in zip(bags, truth, ranked, strict=True):
                picked = rank[: EXTREME if label == 0 else max(1, min(EXTREME, len(own) // 8))]
                if label == 0:
                    picked = np.concatenate([picked, rng.permutation(len(own))[:BAGS]])
                chosen += [own[i] for i in picked]
                of += [label] * len(picked)
            if chosen:
                trainer.learn(chosen, np.array(of))
    model = trainer.model()
    model.slope, model.shift = fitted_sigmoid(model.margins(pa.array([texts[i] for i in kept_back])), labels[kept_back])
    return model


def trained(docs: DataFrame, labels: DataFrame, learn: F.Column, per_label: int = PER_LABEL) -> Model | None:
    """Learns from ``labels`` (doc_id, label) for which ``learn`` holds; None without both labels."""
    got = sampled_texts(docs, labels.where(learn), per_label)
    truth = np.array(got.column("label").to_pylist(), np.int64)
    if len(set(truth.tolist())) < 2:
        return None
    return fit(got.column("text").to_pylist(), truth)


def scored(docs: DataFrame, model) -> DataFrame:
    """``docs`` (doc_id, text, ...) with score, by any model with ``scores(texts)``; a column of this name is replaced."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever the corpus
    return docs.mapInArrow(add_columns({"score": pa.float64()}, lambda b: [sent.value.scores(b.column("text"))]), f"{fields(docs)}, score double")
