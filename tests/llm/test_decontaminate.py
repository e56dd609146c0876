import random

from netloom.llm.decontaminate import brute_force, contamination, digest
from llm_cases import sorted_rows, words

ITEMS = "item_id long, text string, extra string"


def made(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n)), "x") for i, n in enumerate([1, 3, 9, 10, 11, 40, 12])]
    items += [(7, None, None), (8, "... !", None), (9, items[5][1].upper(), None), (5, items[5][1], "again")]
    docs = []
    for i in range(40):
        own = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items)[1] or ""
            part = source.split()
            begin = rng.randrange(max(1, len(part)))
            at = rng.randint(0, len(own))
            own[at:at] = part[begin : begin + rng.choice([3, 9, 10, 15, 40])]
        docs.append((i, rng.choice([" ", ", ", "\n", " -- "]).join(own), "en", None, 1, None, None))
    docs += [(50, None, None, None, None, None, None), (51, "", None, None, None, None, None)]
    return docs, items


def test_against_brute_force(spark, edge):
    docs, items = made(spark)
    frame = spark.createDataFrame(docs, edge.schema).union(edge)
    expected = brute_force([(r.doc_id, r.text) for r in frame.collect()], [i[:2] for i in items])
    found = contamination(frame, spark.createDataFrame(items, ITEMS))
    assert sorted_rows(digest(found)) == sorted(expected, key=repr)
    assert any(r[-1] for r in expected) and found.columns[: len(frame.columns)] == frame.columns


def test_many_shares_give_the_same(spark, edge):
    docs, items = made(spark)
    frame, items = spark.createDataFrame(docs, edge.schema), spark.createDataFrame(items, ITEMS)
    assert sorted_rows(digest(contamination(frame, items, max_item_chars=100))) == sorted_rows(digest(contamination(frame, items)))


def test_places_are_those_of_the_original_text(spark):
    text = "Say: É! One-TWO three,four five six seven eight nine TEN eleven"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    item = "one two three four five six seven eight nine ten"
    row = contamination(docs, spark.createDataFrame([(4, item, "")], ITEMS)).first()
    assert [text[a:b] for a, b in row.places] == ["One-TWO three,four five six seven eight nine TEN"]
    assert row["items"] == ["4"] and row.hits == [[2, 12]]


def test_empty_tables(spark, nothing, edge):
    items = spark.createDataFrame([], ITEMS)
    assert contamination(nothing, items).count() == 0
    assert digest(contamination(edge, items)).where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
