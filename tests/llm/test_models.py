import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import language_id, ngrams, quality_model, toxicity
from netloom.llm.common import id_remainder
from netloom.llm.queries import QUERIES
from netloom.llm.samples import labelled_sample
from llm_cases import words

DATA = "/root/testdata/sf0.1"


def test_remainder_is_that_of_zlib(spark):
    got = spark.range(50).select(id_remainder(F.col("id"), 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]


def held_out(spark, name, label):
    """(labels, predictions) of the rows the model did not learn from."""
    rows = QUERIES[name](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select(label, "predicted")
    got = np.array([tuple(r) for r in rows.collect()])
    return got[:, 0], got[:, 1]


def test_toxicity_on_held_out_documents(spark):
    truth, predicted = held_out(spark, "op2_toxicity", "toxic")
    assert predicted[truth == 1].mean() > 0.9 and predicted[truth == 0].mean() < 0.05


def test_quality_on_held_out_documents(spark):
    truth, predicted = held_out(spark, "op7_quality_classifier", "quality")
    assert predicted[truth == 1].mean() > 0.97 and predicted[truth == 0].mean() < 0.1


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op6_language_id"](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    got = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and 0 <= got[1] <= got[2] <= 1


def test_unseen_misspelling_is_recognised():
    rng = random.Random(0)
    texts, labels = [], []
    for i in range(300):
        own = words(rng, 60)
        if i % 2:
            for _ in range(3):
                own[rng.randrange(60)] = rng.choice(["wretched", "miserable", "abominable"])
        texts.append(" ".join(own))
        labels.append(i % 2)
    model = toxicity.fit(texts, np.array(labels))
    plain = words(rng, 400)
    got = model.scores(pa.array([" ".join(plain), " ".join([*plain, "wrettched", "abomminable", *plain])]))
    assert got[0] < 0.5 < got[1]


@pytest.mark.parametrize("module", [language_id, toxicity, quality_model])
def test_models_cover_edge_cases(spark, edge, nothing, module):
    rows = [r for r in edge.collect()]
    if module is language_id:
        model = module.trained(edge, F.lit(True))
        for frame in (edge, nothing):
            got = module.predicted(frame, model)
            assert got.count() == frame.count()
        by_text = {r.text: r for r in module.predicted(edge, model).collect()}
        assert by_text[None].lang_pred == by_text[""].lang_pred == by_text["!!! ### $$$"].lang_pred == "und"
        assert by_text["one"].lang_pred in {"en", "de"}
        assert module.trained(nothing, F.lit(True)) is None
        assert {r.lang_pred for r in module.predicted(edge, None).collect()} == {"und"}
    else:
        labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
        model = module.trained(edge, labels, F.lit(True))
        got = toxicity.scored(edge, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert toxicity.scored(nothing, model).count() == 0
        assert module.trained(edge, labels.where("label = 1"), F.lit(True)) is None
        assert module.trained(nothing, labels.limit(0), F.lit(True)) is None


def test_scores_do_not_depend_on_the_chunks(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(words(rng, n)) for n in (400, 3, 900, 0, 50)]
    keys = np.random.default_rng(0)
    tox = toxicity.Model(keys.normal(size=1 << toxicity.BITS).astype(np.float32), 0.1, 1.0, 0.0)
    tox.value[0] = 0
    qual = quality_model.Model(keys.normal(size=2 << quality_model.BITS).astype(np.float32), 0.1)
    lang = language_id.Model(["a", "b"], keys.normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.zeros(2), 1.0)
    lang.weights[0] = 0
    whole = ngrams.chunks
    for model in (tox, lang):
        expected = model.margins(pa.array(texts))
        monkeypatch.setattr(ngrams, "chunks", lambda t: whole(t, 700))
        got = model.margins(pa.array(texts))
        monkeypatch.setattr(ngrams, "chunks", whole)
        if model is lang:
            np.testing.assert_allclose(got, expected, rtol=1e-3, atol=1e-2)
        else:  # a cut moves the bags of an overlong text; the others are the same
            np.testing.assert_allclose(got[[1, 3]], expected[[1, 3]], rtol=1e-5)
    each = np.array([qual.margins(pa.array([t]))[0] for t in texts])
    np.testing.assert_allclose(qual.margins(pa.array(texts)), each, rtol=1e-4)


def test_sample_is_bounded_and_whole_where_it_is_small(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "rare").otherwise("common").alias("label"))
    got = {r[0]: r[1] for r in labelled_sample(rows, 100).groupBy("label").count().collect()}
    assert got["rare"] == 30 and 60 < got["common"] < 150
    hot = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("x").alias("label"))
    assert labelled_sample(hot, 100).count() <= 200
