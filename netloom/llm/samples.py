"""Bounded samples of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def labelled_sample(rows: DataFrame, per_label: int, seed: int = 1) -> DataFrame:
    """About ``per_label`` rows of each ``label`` of (doc_id, label), chosen by a hash of the id.

    Counts the labels over all rows first. However often an id repeats, twice the stated
    number of rows is the most. Rows without a label are left out.
    """
    rows = rows.where("label IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return rows
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == F.lit(label), F.lit(min(_STEPS, _STEPS * per_label // n))).otherwise(share)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_STEPS)) < share
    return rows.where(chosen).limit(2 * per_label * len(counts))


def sampled_texts(docs: DataFrame, labels: DataFrame, per_label: int) -> pa.Table:
    """(doc_id, label, text) of a sample, on the driver, in the order of the ids."""
    chosen = labelled_sample(labels, per_label)
    bound = 2 * per_label * max(1, chosen.select("label").distinct().count())
    joined = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").limit(bound)
    return joined.select("doc_id", "label", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fitted_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of score = sigmoid(a * margin + b), by Newton steps on smoothed targets; both labels count alike."""
    if len(margins) == 0 or labels.min() == labels.max():
        return 1.0, 0.0
    scale = max(float(np.abs(margins).max()), 1e-9)
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    positive = labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive)) * len(labels)
    ab = np.zeros(2)
    for _ in range(100):
        p = sigmoid(x @ ab)
        gradient = x.T @ (weight * (p - target)) + 1e-3 * ab
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(ab[0] / scale), float(ab[1])
