import random

import pytest

import corpus_pipeline
from netloom.llm.near_dedup import words_of
from netloom.llm.packing import LENGTH, encoder
from llm_cases import DOCS, edge_rows, words
from test_lines_rules_spans import brute_lines
from test_near_dedup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in two languages with shared lines, near copies and benchmark passages."""
    rng = random.Random(12)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(letters))
        own = ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(30, 90))]
        text = " ".join(own) + ("\nshared line of all" if i % 2 else "")
        rows.append((i, text, lang, f"s{i % 13}", len(text), None, None))
    item = " ".join("".join(rng.choice("vwxyz") for _ in range(4)) for _ in range(25))
    rows += [(200 + k, r[1] + " " + r[1].split()[0], *r[2:]) for k, r in enumerate(rows[:15])]
    rows += [(300 + k, r[1] + " " + item, *r[2:]) for k, r in enumerate(rows[20:26])]
    rows += [(400, "123 456 !!!", "aa", "s1", 11, None, None), (401, None, None, None, None, None, None)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        seen[name] = (before, [tuple(r) for r in docs.collect()])
        assert name == "packing" or docs.columns == columns
    before, after = seen["language_id"]
    assert {r[0] for r in before} - {r[0] for r in after} == {400, 401}
    before, after = seen["line_dedup"]
    expected = brute_lines([(r[0], r[1], r[3]) for r in before], 10)
    assert sorted(((r[0], r[1]) for r in after), key=repr) == sorted(((r[0], r[1]) for r in expected), key=repr)
    assert any(r[3] for r in expected) and all(r[4] == len(r[1]) for r in after)
    before, after = seen["near_dedup"]
    kept = [r[0] for r in brute([(r[0], r[1]) for r in before]) if r[3]]
    assert sorted(r[0] for r in after) == sorted(kept) and len(kept) < len(before)
    before, after = seen["decontamination"]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text.split()
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = [r for r in before if not any(tuple(w) in windows for w in zip(*(r[1].split()[k:] for k in range(10)), strict=False))]
    assert sorted(r[0] for r in after) == sorted(r[0] for r in clean) and len(clean) < len(before)
    before, after = seen["packing"]
    tokens = {r[0]: len(encoder("byte_bpe_50k.json").exact.encode(r[1], add_special_tokens=False).ids) + 1 for r in before}
    assert sum(tokens.values()) == sum(r[2] for r in after) and {r[0] for r in after} == set(tokens)
    assert max(r[2] for r in after) <= LENGTH


def test_run_gives_what_the_stages_give(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.mark.parametrize("rows", [[], edge_rows()])
def test_stages_cover_edge_cases(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert (docs.count() > 0) == bool(rows)
    assert not rows or words_of(rows[9][1])
