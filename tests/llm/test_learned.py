"""Toxicity and language identification: held-out accuracy, defined odd cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankdraft.llm import language_id, toxicity
from rankdraft.llm.common import fold, read
from rankdraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_toxicity_of_held_out_documents(spark):
    found = QUERIES["op1_toxicity"](spark, SF)
    joined = found.join(read(spark, SF, "labels"), "doc_id").filter("held_out")
    right = joined.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.93
    assert found.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    assert found.count() == read(spark, SF, "documents").count()


def test_labels_of_the_held_out_fold_are_not_learned_from(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    part = fold(F.col("doc_id"))
    turned = labels.withColumn(
        "toxic", F.when(part == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    a = toxicity.fit(docs, labels, trainable=part != 0)
    b = toxicity.fit(docs, turned, trainable=part != 0)
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_the_risk_estimator_recovers_a_known_prior():
    draw = np.random.default_rng(2)
    positive = (draw.random((500, 3)) < [0.9, 0.5, 0.5]).astype(np.float32)
    clean = (draw.random((3200, 3)) < [0.05, 0.5, 0.5]).astype(np.float32)
    hidden = (draw.random((800, 3)) < [0.9, 0.5, 0.5]).astype(np.float32)
    model = toxicity.train(
        np.arange(3, dtype=np.uint64), positive, np.concatenate((clean, hidden)), 0.2
    )
    score = lambda x: toxicity.sigmoid(x @ model.weights + model.bias)
    mean = np.concatenate((score(clean), score(hidden))).mean()
    assert abs(mean - 0.2) < 0.05
    assert (score(hidden) > 0.5).mean() > 0.8 and (score(clean) < 0.5).mean() > 0.9


ROWS = [(1, "an idiot wrote this", "en"), (None, "x", "en"), (3, None, None), (4, "", "en")]


@pytest.fixture
def odd(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(*r, "clash") for r in [*ROWS, ROWS[0], (5, "word " * 200_000, "en")]]
    return spark.createDataFrame(rows, schema)


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (None, 1), (3, 1), (4, None)], "doc_id long, toxic int"
    )
    model = toxicity.fit(odd, labels)
    found = toxicity.score(odd, model).collect()
    assert len(found) == 6
    empty = {r.score for r in found if r.doc_id in (3, 4)}
    assert len(empty) == 1
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns


def test_nothing_to_learn_from(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    empty = odd.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
    model = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, model).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    found = QUERIES["op9_language_id"](spark, SF)
    lang = read(spark, SF, "documents").select("doc_id", "lang")
    joined = found.join(lang, "doc_id").filter("held_out")
    right = joined.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_texts_without_letters_have_no_language(spark):
    docs = read(spark, SF, "documents")
    model = language_id.fit(docs)
    column = pa.array([None, "", "123 .. 🙂", "the house of the", "Ω"])
    languages, cosine, rejected = model.predict(column)
    assert languages[:3] == ["und"] * 3 and languages[3] == "en" and languages[4] != "und"
    assert list(cosine[:3]) == [0, 0, 0] and rejected[:3].all() and rejected[4]


def test_centroids_are_units_and_stay_with_few_texts():
    counts, _ = language_id.ngram_counts(["abc abd", "xyz xyz"])
    model = language_id.train(counts, ["a", "x"])
    assert np.allclose(np.linalg.norm(model.vectors, axis=1), 1)
    assert model.predict(pa.array(["abc", "zyx xyz"]))[0] == ["a", "x"]
