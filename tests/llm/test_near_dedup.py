import random

import numpy as np
import pytest

from netloom.llm import near_dedup
from netloom.llm.components import star_forest
from netloom.llm.near_dedup import BANDS, bands_of, near_duplicates, shingle_set, sketches, words_of
from llm_cases import words


def brute(rows, size=5):
    """component and set size of each (id, text), by all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)]
        smallest = None if doc_id is None else min(ids)
        out.append((doc_id, len(sets[i]), smallest, doc_id is None or doc_id == smallest))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in near_duplicates(df, **options).drop("text_key").collect()), key=repr)


@pytest.mark.parametrize("size", [4, 5])
def test_edge_cases_against_all_pairs(edge, size):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert result(edge, shingle=size) == brute(rows, size)


def test_empty_table(nothing):
    assert result(nothing) == []


@pytest.mark.parametrize("pivots", [near_dedup.PIVOTS, (1, 2, None), (1, None)])
def test_chains_of_near_copies(spark, monkeypatch, pivots):
    """A group in which many pairs are close but not linked, reached only through others."""
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    rng = random.Random(8)
    base, rows = words(rng, 120), []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = words(rng, 1)[0]
        if i % 9 == 0:
            base = own  # the group drifts, so that its ends are linked through its middle only
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, " ".join(words(rng, 50))) for i in range(20)] + [(3000, " ".join(base).upper())]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert got == brute(rows, 4)
    assert 1 < len({r[2] for r in got if r[0] <= 1000 or r[0] == 3000}) < 90


def test_every_coordinate_fills_and_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 800).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2)]
    sets.append(sets[0][:1])
    got = sketches(sets)
    assert (got < np.iinfo(np.uint64).max).all()
    assert abs((got[0] == got[1]).mean() - 0.8) < 0.15
    assert len(set(bands_of(got)[0].tolist())) == BANDS


def test_shingles_of_short_texts():
    class Hashes(dict):
        def __missing__(self, w):
            return hash(w) & (2**64 - 1)

    assert len(shingle_set(words_of("A b"), Hashes())) == 1
    assert len(shingle_set(words_of("a b c d e"), Hashes())) == 1
    assert len(shingle_set(words_of("a b c d e"), Hashes(), 4)) == 2
    assert len(shingle_set(words_of(" "), Hashes())) == 0
    assert words_of("A\x0bb C\tÄ") == [b"a", "b c".encode(), "Ä".encode()]


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 80)] + [(7, 7)]
    got = {r.node: r.root for r in star_forest(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 60, 80: 60}
