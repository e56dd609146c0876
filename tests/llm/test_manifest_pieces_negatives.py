"""Merkle manifest, SentencePiece ids and hard negatives against plain Python versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import DOCS, edge_rows
from pyspark.sql import functions as F

from netloom.llm import hard_negatives, merkle, sentence_pieces


# --- Merkle manifest ---------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(cells):
    return sha(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def reduced(nodes):
    """(root, proofs): the digests of the siblings of each node, level by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 8
            proofs[i].append((nodes[run * 8 : place], nodes[place + 1 : run * 8 + 8]))
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return (nodes[0] if nodes else None), proofs


def plain_manifest(rows, held):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    leaf = lambda r: plain_leaf([r[c] for c in merkle.FIELDS])
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    below = {}
    for k in order:
        told = sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        below[k] = (told, *reduced([leaf(r) for r in told]))
    root, above = reduced([below[k][1] for k in order])
    out = []
    for k, top in zip(order, above, strict=True):
        told, subroot, proofs = below[k]
        for r, proof in zip(told, proofs, strict=True):
            path = proof + top
            fold = plain_leaf([held(r) if c == "text" else r[c] for c in merkle.FIELDS])
            for before, after in path:
                fold = sha(*before, fold, *after)
            out.append((r["doc_id"], leaf(r), subroot, root, sha(*(x for a, b in path for x in a + b)), fold))
    return Counter(out)


def manifest_rows(df):
    found = merkle.manifest(df, held={"text": F.lower("text")})
    text = [merkle.hex_text(F.col(c)) for c in ("leaf", "subroot", "root")]
    return Counter(map(tuple, found.select("doc_id", *text, merkle.proof_digest(F.col("path")), merkle.folded(F.col("held_leaf"), F.col("path"))).collect()))


def many(n, langs):
    rng = random.Random(3)
    return [(i, f"Text {rng.random()}", rng.choice(langs), f"s{i % 5}", i, None, None) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("rows", [edge_rows(), many(700, ["a", "a", "a", "b", None, "", "é"]), many(20, [str(i) for i in range(20)]), many(1, ["x"]), many(64, ["x"])])
def test_manifest_equals_plain_trees(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    names = df.columns
    held = lambda r: None if r["text"] is None else r["text"].lower()
    ours = plain_manifest([dict(zip(names, r)) for r in rows], held)
    # lower() of Python and Spark differ on a few letters outside ASCII
    same = [r for r in rows if (r[1] or "").isascii()]
    if len(same) == len(rows):
        assert manifest_rows(df) == ours
    else:
        cut = lambda c: Counter(x[:5] for x in c.elements())
        assert cut(manifest_rows(df)) == cut(ours)


def test_manifest_of_nothing(spark, nothing):
    assert merkle.manifest(nothing).count() == 0


def test_a_change_of_any_cell_breaks_the_proof(spark):
    df = spark.createDataFrame(many(70, ["a", "b"]), DOCS)
    for held in ({"text": F.concat("text", F.lit(" "))}, {"source": F.lit(None).cast("string")}, {"n_chars": F.col("n_chars") + 1}):
        found = merkle.manifest(df, held=held)
        assert found.where(merkle.folded(F.col("held_leaf"), F.col("path")) == merkle.hex_text(F.col("root"))).count() == 0
    kept = merkle.manifest(df)
    assert kept.where(merkle.folded(F.col("held_leaf"), F.col("path")) == merkle.hex_text(F.col("root"))).count() == 70


def test_columns_named_like_the_operators_own(spark):
    df = spark.createDataFrame(many(30, ["a", "b"]), DOCS)
    odd = df.withColumns({c: F.lit(1) for c in ("key", "id", "hash", "held", "pos", "n", "path", "root", "left", "of", "all")})
    assert manifest_rows(odd) == manifest_rows(df)


# --- SentencePiece -----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentence_pieces.Segmenter(sentence_pieces.model_path())


def whole_texts(library, rows):
    ids = {t: library.library.encode(t or "", add_eos=True) for _, t in rows}
    return Counter((i, tuple(ids[t]), library.library.decode(ids[t])) for i, t in rows)


def in_blocks(docs, **options):
    return Counter((r.doc_id, tuple(r.ids), r.decoded) for r in sentence_pieces.encoded(docs, **options).collect())


def test_pieces_of_odd_texts(spark, edge, library):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert in_blocks(edge) == whole_texts(library, rows)


def test_pieces_in_small_blocks(spark, library):
    rng = random.Random(7)
    letters = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "日本", "é", "<s>", "</s>", "<0x41>", "😀", "́", "\x00", "12"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1, "   "), (2, "▁"), (3, " ▁ "), (4, "a "), (5, " a"), (6, "▁▁a▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert in_blocks(docs, block=500) == whole_texts(library, rows)


def test_chunks_are_markers_and_the_word_behind_them(library):
    for text in ("one two  three   four ", "x" * 100 + " y", "   ", "a" + " " * 90 + "b", "", "▁", " ".join("ab" for _ in range(90))):
        marked = library.library.normalize(text)
        assert [c for c in library.separated(text).split(" ") if c] == re.findall("▁*[^▁]+|▁+", marked)


def test_packed_numbers():
    for values in ([], [0], [1, 2, 255, 256, 1 << 31], list(range(1000))):
        assert sentence_pieces.unpacked(sentence_pieces.packed(values)).tolist() == values


def test_pieces_of_nothing_and_without_an_end(spark, nothing, edge, library):
    assert sentence_pieces.encoded(nothing).count() == 0
    none = sentence_pieces.encoded(edge.where("text is null"), end=False).collect()
    assert none and all(r.ids == [] and r.decoded == "" for r in none)


def test_models_with_crossing_pieces_are_refused(library, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b")
    with pytest.raises(ValueError, match="cross"):
        sentence_pieces.Segmenter(sentence_pieces.model_path())


# --- hard negatives ----------------------------------------------------------


def plain_negatives(rows, is_anchor):
    """``rows`` are distinct (id, label, integers)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in rows))
        for s, p, label in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:5]:
            hard = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a[0], p, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(hard)]
    return Counter(out)


VECTORS = "vec_id long, label long, vector array<long>"


def clustered(n, dims, labels, seed=1, ids=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * 60
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((ids[i] if ids else i, label, [int(x) for x in centres[(label + (i % 4 == 0)) % labels] + rng.normal(size=dims) * 40]))
    return rows


def mined_rows(df, anchors, **options):
    return Counter(map(tuple, hard_negatives.mined(df, anchors, **options).collect()))


@pytest.mark.parametrize("dims,block", [(32, 100), (16, 4096), (3, 37), (1, 50)])
def test_negatives_equal_every_pair_scored(spark, dims, block):
    rows = clustered(600, dims, 5)
    df = spark.createDataFrame(rows, VECTORS)
    found = mined_rows(df, F.col("vec_id") % 10 == 0, block=block, anchor_block=25)
    assert found == plain_negatives(rows, lambda i: i % 10 == 0)
    assert found


def test_one_vector_that_most_rows_share(spark):
    rows = clustered(200, 8, 3) + [(1000 + i, i % 3, [50, -20, 30, 5, 5, 5, 0, 9]) for i in range(500)]
    df = spark.createDataFrame(rows + rows[:20], VECTORS)
    assert mined_rows(df, F.col("vec_id") % 20 == 0, block=64) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_short_empty_and_zero_vectors(spark):
    rows = [(0, 1, [5, 5]), (1, 1, [5]), (2, 1, []), (3, 2, [4, 4, 9]), (4, 2, [3]), (5, 2, [0, 0, 0]), (6, 1, [0]), (7, 3, [-4]), (8, 9, [1])]
    filled = [(i, label, v + [0] * (3 - len(v))) for i, label, v in rows]
    df = spark.createDataFrame(rows, VECTORS)
    assert mined_rows(df, F.col("vec_id") >= 0, block=2, anchor_block=2) == plain_negatives(filled, lambda i: True)


def test_large_components_stay_exact_or_stop(spark):
    rows = [(i, i % 2, [(1 << 30) + 7 * i, (1 << 29) - i]) for i in range(40)]
    far = [(i, label, [x // 2 for x in v] if label else v) for i, label, v in rows]
    df = spark.createDataFrame(far, VECTORS)
    assert mined_rows(df, F.col("vec_id") % 5 == 0) == plain_negatives(far, lambda i: i % 5 == 0)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mined(spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], VECTORS), F.lit(True)).collect()


def test_rows_that_take_part(spark):
    rows = [
        (1, [1.0, -0.001], 3), (2, None, 3), (3, [0.5], None), (None, [0.5], 1), (4, [float("nan")], 1), (5, [float("inf")], 1), (6, [None], 1), (7, [], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vector", F.lit("clash"))
    found = {tuple(r) for r in hard_negatives.integer_vectors(df, "vec_id", "embedding", F.col("label")).selectExpr("vec_id", "label", "cast(vector as string)").collect()}
    assert found == {(1, 3, "[256, -1]"), (7, 1, "[]")}


def test_negatives_of_nothing(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def test_summaries_bound_every_score_and_leave_few(spark):
    # Neighbouring components alike, as in signals; summaries of independent ones bound the scores too, but leave all.
    rows = np.repeat(np.array([r[2] for r in clustered(500, 16, 5)], np.int64), 4, axis=1)
    rows += np.random.default_rng(2).integers(-2, 3, rows.shape)
    a, b = hard_negatives.Entries(rows[:50]), hard_negatives.Entries(rows)
    exact, widths = rows[:50] @ rows.T, []
    for level in range(len(hard_negatives.LEVELS)):
        low, up = hard_negatives.bounds(a, np.arange(50), b, np.arange(500), level)
        assert (low <= exact).all() and (exact <= up).all()
        widths.append((up - low).mean())
    assert widths[1] < widths[0]
    left = sum(len(found) for _, found, _ in hard_negatives.best_of_label(a, np.arange(50), b, np.arange(500), 6))
    assert left < 0.5 * 50 * 500
