"""Scores of the n-gram classifiers against per-text versions with dictionaries and plain integers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import edge_rows, words

from netloom.llm import language_id, toxicity

# Fixed values of the character hash.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD6E8FEB9)


def key(gram, bits):
    h = len(gram) * 0x51ED27 + 1
    for c, factor in zip(gram, FACTORS, strict=False):
        h = (h ^ ord(c)) * factor & 0xFFFFFFFF
        h ^= h >> 15
    return (h * FACTORS[5] & 0xFFFFFFFF) >> (32 - bits)


def small(c):
    return chr(ord(c) + 32) if "A" <= c <= "Z" or 0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7 else c


def texts(seed=5):
    rng = random.Random(seed)
    letters = ["a", "b", "Z", "é", "É", "ß", " ", " ", "\n", "\t", ".", "1", "日", "ñ", "x", "-", " "]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    made += [" ".join(words(rng, rng.randint(1, 40))) for _ in range(60)]
    return made + [r[1] for r in edge_rows() if r[1] and len(r[1]) < 3000] + ["  ", ".", "a"]


@pytest.fixture(scope="module")
def language_model():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << language_id.BITS, 3)).astype(np.float32)
    weights[0] = 0
    return language_id.Model(["aa", "bb", "cc"], weights, np.array([0.1, -0.2, 0.3]), 1.7)


def plain_language(model, text):
    def letter(c):
        n = ord(c)
        if n < 128:
            return c.isalpha()
        gaps = n in (0xD7, 0xF7, 0xFEFF, 0xFFFD) or 0x2000 <= n < 0x2C00 or 0x3000 <= n < 0x3040
        return n >= 0xC0 and not gaps or n in (0xAA, 0xB5, 0xBA)

    padded = "".join(c if letter(c) else " " for c in map(small, f" {text} "))
    seen = {}
    for size in (1, 2, 3):
        for i in range(len(padded) - size + 1):
            gram = padded[i : i + size]
            if gram.strip(" ") and " " not in gram[1:-1] and not (size == 1 and gram == " "):
                k = key(gram, language_id.BITS)
                if k:
                    seen[k] = seen.get(k, 0) + 1
    n = max(1, sum(seen.values()))
    margins = [language_id.SCALE * sum(c * float(model.weights[k][j]) for k, c in seen.items()) / n + model.bias[j] for j in range(3)]
    top = max(margins)
    raised = [math.exp((m - top) / model.temperature) for m in margins]
    return [x / sum(raised) for x in raised]


def test_language_scores_equal_a_dictionary_per_text(language_model):
    made = texts()
    got = language_model.probabilities(pa.array(made))
    for text, row in zip(made, got, strict=True):
        assert np.allclose(row, plain_language(language_model, text), atol=2e-4), text


@pytest.fixture(scope="module")
def toxicity_model():
    value = np.random.default_rng(2).normal(size=1 << toxicity.BITS)
    value[0] = 0
    return toxicity.Model(value, 0.25, 1.5, -0.5)


def plain_toxicity(model, text):
    def gap(c):
        n = ord(c)
        return n <= 32 or n in (0x85, 0xA0, 0x2028, 0x3000) or 0x2000 <= n <= 0x200A

    padded = "".join(" " if gap(c) else small(c) for c in f" {text} ")
    # Words are counted from the first one, or from the gap in front of it if a text begins with several.
    blocks, word, first = {}, 0, int(padded[1:2].strip(" ") != "")
    for i, c in enumerate(padded):
        if c == " " and padded[i + 1 : i + 2].strip(" "):
            word += 1  # the gap in front of a word is the word's
        at = blocks.setdefault(max(word - first, 0) // toxicity.BLOCK, [0.0, 0])
        for size in toxicity.SIZES:
            gram = padded[i : i + size]
            if len(gram) == size and gram.strip(" ") and " " not in gram[1:-1]:
                k = key(gram, toxicity.BITS)
                if k:
                    at[0] += model.value[k]
                    at[1] += 1
    both = [blocks[b] if b + 1 not in blocks else [x + y for x, y in zip(blocks[b], blocks[b + 1])] for b in sorted(blocks)]
    margin = max(total / max(n, 1) + model.bias for total, n in both)
    return 1 / (1 + math.exp(-(model.slope * margin + model.shift)))


def test_toxicity_scores_equal_bags_per_text(toxicity_model):
    made = texts(9)
    got = toxicity_model.scores(pa.array(made))
    for text, score in zip(made, got, strict=True):
        assert abs(score - plain_toxicity(toxicity_model, text)) < 1e-9, text
