import random

import pytest

from netloom.llm import line_dedup
from netloom.llm.line_dedup import without_widespread_lines
from netloom.llm.quality_rules import judged, measured_order, base_numbers, rules
from netloom.llm.span_dedup import RUN, cut_out, run_hashes, runs, units, without_repeats
from llm_cases import sorted_rows, words


def brute_lines(rows, min_sites):
    sites, first = {}, {}
    for doc_id, text, site in rows:
        for place, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\r")
            if key and text is not None:
                sites.setdefault(key, set()).add(site)
                at = (doc_id is not None, doc_id or 0, place)
                first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text, _ in rows:
        lines, removed = (text.split("\n") if text is not None else []), 0
        left = []
        for place, line in enumerate(lines):
            key = line.strip(" \t\r")
            if key and len(sites[key] - {None}) >= min_sites and (doc_id is not None, doc_id or 0, place) != first[key]:
                removed += 1
            else:
                left.append(line)
        out.append((doc_id, None if text is None else "\n".join(left), len(lines), removed))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 3, 10])
def test_lines_against_brute_force(spark, min_sites):
    rng = random.Random(min_sites)
    pool = [" ".join(words(rng, 4)) for _ in range(12)] + ["", "  "]
    rows = []
    for i in range(120):
        lines = [rng.choice(["", " ", "\r"]) + rng.choice(pool) if rng.random() < 0.6 else " ".join(words(rng, 5)) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines), rng.choice([None, *(f"s{k}" for k in range(14))])))
    rows += [(None, pool[0], "s1"), (200, None, "s2"), (201, "", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = without_widespread_lines(docs, min_sites).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted_rows(got) == brute_lines(rows, min_sites)


def test_sketch_is_decided_exactly_near_the_threshold(spark, monkeypatch):
    """With the coarsest sketch the estimates are off; lines near the threshold still come out right."""
    monkeypatch.setattr(line_dedup, "LG_K", 4)
    rows = [(1000 * k + i, f"line {k}", f"site {i}") for k, n in enumerate(range(28, 34)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = without_widespread_lines(docs, 30).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted_rows(got) == brute_lines(rows, 30)


def test_lines_edge_cases(spark, edge, nothing):
    got = without_widespread_lines(edge, 2)
    assert got.count() == edge.count() and got.where("text IS NULL").count() == edge.where("text IS NULL").count()
    assert without_widespread_lines(nothing).count() == 0


def brute_numbers(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(3))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_base_numbers_against_brute_force(spark, edge):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n#x\n#x\n"])) for i in range(60)]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    numbers = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    got = sorted_rows(judged(docs).select("doc_id", *numbers))
    assert got == sorted([(r.doc_id, *brute_numbers(r.text)) for r in docs.collect()], key=repr)


def test_verdict_does_not_depend_on_the_order(spark, edge, monkeypatch):
    from netloom.llm import quality_rules

    kept = []
    for order in (list(rules()), list(rules())[::-1]):
        monkeypatch.setattr(quality_rules, "measured_order", lambda *a, o=order, **k: o)
        kept.append(sorted_rows(judged(edge).select("doc_id", "n_words", "base_failed", "kept")))
    assert kept[0] == kept[1]
    assert sorted(measured_order(edge)) == sorted(rules())


def test_rules_on_no_rows(nothing):
    assert judged(nothing).count() == 0


def test_rules_keep_prose_and_reject_junk(spark):
    rng = random.Random(3)
    prose = ". ".join(" ".join(words(rng, 9)) for _ in range(12)) + "."
    junk = ["!! ".join(prose.split()), "*** ".join(prose.split()), prose.upper(), "word " * 100, "few words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([prose, *junk])], "doc_id long, text string")
    assert [r.kept for r in judged(docs).orderBy("doc_id").collect()] == [True] + [False] * 5


def brute_spans(rows):
    first, lost = {}, {i: set() for i in range(len(rows))}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for place, *key in run_hashes(text):
            at = (doc_id is not None, doc_id or 0, place)
            first[tuple(key)] = min(first.get(tuple(key), at), at)
    for n, (doc_id, text) in enumerate(rows):
        for place, *key in run_hashes(text):
            if first[tuple(key)] != (doc_id is not None, doc_id or 0, place):
                lost[n].update(range(place, place + RUN))
    return sorted([(d, cut_out(t, lost[n]) if lost[n] else t, len(list(units(t))), len(lost[n])) for n, (d, t) in enumerate(rows)], key=repr)


def test_spans_against_brute_force(spark):
    rng = random.Random(6)
    passages = [". ".join(" ".join(words(rng, rng.randint(2, 14))) for _ in range(5)) + ". " for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(words(rng, 12)) + ". " for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice(["", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (None, passages[0])]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted_rows(got.select("doc_id", "text", "n_units", "n_removed")) == brute_spans(rows)


def test_passage_of_over_fifty_words_is_caught_wherever_it_stands(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 55))  # no punctuation at all
    rows = [(i, " ".join(words(rng, 40 + i)) + " " + passage + " " + " ".join(words(rng, 30))) for i in range(6)] + [(9, " ".join(words(rng, 90)))]
    got = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and got[9] == 0 and all(got[i] >= 3 for i in range(1, 6))


def test_spans_edge_cases(edge, nothing):
    got = without_repeats(edge)
    assert got.count() == edge.count() and "score" in got.columns
    assert without_repeats(nothing).count() == 0


def test_cutting_leaves_the_rest_alone():
    text = "A b c d. E f g h. I j k l.\n  M n\x00o p.\nQ"
    assert [text[a:b] for a, b, _ in units("A b c d. E f g h.\nxx")][0] == "A b c d."
    assert cut_out(text, set()) == text
    assert cut_out(text, {1}).startswith("A b c d. I j k l.\n  M n\x00o p.")
    assert cut_out("A b c d.\nE f g h.", {0}) == "E f g h."


def shaped(rng, n, shape):
    """``n`` invented words; as prose, without marks, as a list of three words a line, or characters without spaces."""
    if shape == "unspaced":
        return "".join(rng.choice("。" if rng.random() < 0.05 else [chr(rng.randint(0x4E00, 0x9FFF))]) for _ in range(2 * n))
    own = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    if shape == "list":
        return "\n".join(" ".join(own[i : i + 3]) for i in range(0, n, 3))
    return " ".join(w + "." if shape == "prose" and rng.random() < 0.1 else w for w in own)


@pytest.mark.parametrize("shape", ["prose", "unmarked", "list", "unspaced"])
def test_fifty_words_always_hold_a_run(shape):
    for seed in range(400):
        rng = random.Random(seed)
        passage = shaped(rng, 51, shape)
        sep = {"list": "\n", "unspaced": ""}.get(shape, " ")
        a, b = (sep.join([shaped(rng, rng.randint(1, 40), shape), passage, shaped(rng, rng.randint(1, 40), shape)]) for _ in range(2))
        assert {r[1:] for r in run_hashes(a)} & {r[1:] for r in run_hashes(b)}, seed


def test_lists_and_unspaced_passages_are_removed(spark):
    for shape, sep in (("list", "\n"), ("unspaced", "")):
        rng = random.Random(4)
        passage = shaped(rng, 54, shape)
        rows = [(i, sep.join([shaped(rng, 30, shape), passage, shaped(rng, 30, shape)])) for i in range(3)]
        rows.append((3, shaped(rng, 90, shape)))
        got = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0].text == rows[0][1] and got[3].text == rows[3][1]
        assert all(len(rows[i][1]) - len(got[i].text) > len(passage) // 3 for i in (1, 2))


def test_units_may_cross_lines():
    text = "a b\n\nc d\ne f"
    (begin, end, _), = units(text)
    assert (begin, end) == (0, len(text)) and cut_out(text, {0}) == "" and cut_out(text + "\nx y z. u v w x.", {0}).endswith("u v w x.")


def test_a_run_of_many_short_units_is_one_row(spark):
    rng = random.Random(5)
    for shape in ("list", "unspaced", "prose"):
        text = shaped(rng, 200, shape)
        rows = runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        hashed = run_hashes(text)
        assert len({r[0] for r in hashed if r[3] == 0}) == len([r for r in hashed if r[3] == 0]) == len(rows)
        assert {place + at for place, *_, at in hashed if at} or shape == "prose"
        assert {(r.h1, r.h2) for r in rows} == {r[1:3] for r in hashed} and all(-(2**31) <= r.h2 < 2**31 for r in rows)


def test_texts_hashed_together_have_the_runs_of_each(spark):
    rng = random.Random(8)
    rows = [(i, shaped(rng, rng.randint(0, 120), rng.choice(["list", "unspaced", "prose"]))) for i in range(300)]
    got = runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", "h1", "h2").collect()
    assert sorted(map(tuple, got)) == sorted((i, h1, h2) for i, text in rows for _, h1, h2, at in run_hashes(text) if at == 0)
