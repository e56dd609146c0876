"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters inside words, their ends marked by a space.
A text's value for one is its share among the text's n-grams times the inverse document
frequency. The weights are learned by follow-the-regularised-leader with an L1 and an L2
penalty, document by document; a part of the sample that is left out of learning then sets the
temperature of the probabilities. As term frequencies are shares, a text's margins are the mean
of its n-grams' weights: one gather per n-gram over the whole text, in chunks of bounded size.

The classifier, the inverse document frequencies included, is fitted on a bounded sample:
about ``PER_LANGUAGE`` documents per language, whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0, also where nothing
could be learned. Null ids are predicted, never learned from. Repeated rows are predicted each; among
equally likely languages the first by name counts. Extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import ngrams
from netloom.llm.common import add_columns, fields
from netloom.llm.samples import labelled_sample

PER_LANGUAGE = 800
BITS = 16
SIZES = (1, 2, 3)
EPOCHS = 4
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
#: Shares are small numbers; the margins are in this unit.
SCALE = 20.0


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # per key and language, times the inverse document frequency
    bias: np.ndarray
    temperature: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for codes, starts, owners in ngrams.chunks(texts):
            keys = _keys(codes)
            value = np.zeros((len(codes), len(self.languages)), np.float32)
            held = np.zeros(len(codes), np.int32)
            for own in keys:
                value[: len(own)] += self.weights[own]
                held[: len(own)] += own > 0
            total += ngrams.sums(value, starts, owners, len(texts))
            count += ngrams.sums(held, starts, owners, len(texts))
        return SCALE * total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return _softmax(self.margins(texts) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _keys(codes: np.ndarray) -> list[np.ndarray]:
    """The n-gram key at each place, per size; 0 where there is none. Key 0 is never a feature."""
    low = ngrams.lowered(codes)
    word = ngrams.letters(low)
    low = np.where(word, low, np.uint32(ngrams.SPACE))
    return [np.where(ngrams.inside_word(~word, n), ngrams.hashed(low, n, BITS), 0) for n in SIZES]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a whole text and how often each occurs."""
    total = np.zeros(1 << BITS, np.int64)
    for codes, _, _ in ngrams.chunks(pa.array([text])):
        for own in _keys(codes):
            total += np.bincount(own, minlength=1 << BITS)
    total[0] = 0
    keys = np.flatnonzero(total)
    return keys.astype(np.int32), total[keys].astype(np.int32)


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """FTRL-proximal on (keys, counts) of each document, then the temperature on every fifth."""
    languages = sorted(set(labels))
    truth = np.array([languages.index(x) for x in labels])
    frequency = np.zeros(1 << BITS)
    for keys, _ in documents:
        frequency[keys] += 1
    idf = np.log((1 + len(documents)) / (1 + frequency)) + 1
    valued = [SCALE * counts / max(1, counts.sum()) * idf[keys] for keys, counts in documents]
    z = np.zeros((1 << BITS, len(languages)))
    n = np.zeros_like(z)
    bias = np.zeros(len(languages))

    def weights(keys):
        own, seen = z[keys], n[keys]
        w = (np.sign(own) * L1 - own) / ((BETA + np.sqrt(seen)) / ALPHA + L2)
        w[np.abs(own) <= L1] = 0
        return w, seen

    order = np.random.default_rng(seed).permutation(len(documents))
    kept_back = order[::5] if len(order) >= 5 * len(languages) else order
    learned = np.setdiff1d(order, kept_back) if len(kept_back) < len(order) else order
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(learned):
            keys, x = documents[i][0], valued[i]
            w, seen = weights(keys)
            p = _softmax((x @ w + bias)[None])[0]
            p[truth[i]] -= 1
            gradient = x[:, None] * p
            rate = (np.sqrt(seen + gradient**2) - np.sqrt(seen)) / ALPHA
            z[keys] += gradient - rate * w
            n[keys] += gradient**2
            bias -= 0.01 * p
    every, _ = weights(np.arange(1 << BITS))
    margins = np.array([valued[i] @ every[documents[i][0]] + bias for i in kept_back])
    losses, doubt = {}, 1 / (len(kept_back) + 2)  # else a faultless sample asks for certainty
    for temperature in np.geomspace(0.02, 50, 80):
        log_p = np.log(np.maximum(_softmax(margins / temperature), 1e-30))
        losses[temperature] = -((1 - doubt) * log_p[np.arange(len(kept_back)), truth[kept_back]] + doubt * log_p.mean(axis=1)).mean()
    every = (every * idf[:, None]).astype(np.float32)
    every[0] = 0
    return Model(languages, every, bias, float(min(losses, key=losses.get)))


def trained(docs: DataFrame, learn: F.Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from (doc_id, text, lang) rows for which ``learn`` holds; None without any."""
    rows = docs.select("doc_id", "text", F.col("lang").alias("label")).where(learn).where("text IS NOT NULL")

    def features(batch: pa.RecordBatch) -> list:
        found = [counted(t.as_py()) for t in batch.column("text")]
        return [[f[0] for f in found], [f[1] for f in found]]

    kinds = {"keys": pa.list_(pa.int32()), "counts": pa.list_(pa.int32())}
    sample = labelled_sample(rows, per_language).mapInArrow(
        add_columns(kinds, features, ["text"]), "doc_id long, label string, keys array<int>, counts array<int>"
    )
    got = sample.toArrow().sort_by([("doc_id", "ascending")])
    if not got.num_rows:
        return None
    pairs = [(k.values.to_numpy(), c.values.to_numpy()) for k, c in zip(got.column("keys"), got.column("counts"), strict=True)]
    return fit(pairs, got.column("label").to_pylist())


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights per language, whatever the corpus

    def of_batch(batch: pa.RecordBatch) -> list:
        p = sent.value.probabilities(batch.column("text"))
        best = p.argmax(axis=1)
        return [[sent.value.languages[i] for i in best], p[np.arange(len(p)), best]]

    found = docs.mapInArrow(
        add_columns({"lang_pred": pa.string(), "score": pa.float64()}, of_batch), f"{fields(docs)}, lang_pred string, score double"
    )
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.withColumns(
        {"lang_pred": F.when(lettered, F.col("lang_pred")).otherwise("und"), "score": F.when(lettered, F.col("score")).otherwise(0.0)}
    )
