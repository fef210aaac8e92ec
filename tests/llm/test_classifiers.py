import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.llm import quality, toxicity
from layerframe.llm.queries import op6_toxicity, op9_quality

LARGER = "/root/testdata/sf0.01"


def auc(truth, scores):
    rank = np.argsort(np.argsort(scores)) + 1.0
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def joined(spark, query, label):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    return query(spark, LARGER).join(labels, "doc_id").where(F.col(label).isNotNull()).toPandas()


def test_toxicity_on_held_out_rows(spark):
    got = joined(spark, op6_toxicity, "toxic")
    held = got[got.held_out]
    assert auc(held.toxic.values, held.score.values) > 0.7
    seen = got[~got.held_out]
    assert auc(seen.toxic.values, seen.score.values) > 0.95
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_on_held_out_rows(spark):
    got = joined(spark, op9_quality, "quality")
    held = got[got.held_out]
    assert auc(held.quality.values, held.tail_probability.values) > 0.9
    assert held.kept[held.quality == 1].mean() > 0.95
    assert got.expected_grade.between(0, 2).all() and got.tail_probability.between(0, 1).all()


@pytest.fixture
def edges(spark):
    long = "fine words here " * 20_000
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (3, long, "en", "x"), (3, long, "en", "x"), (None, "?!", "xx", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxicity string")


def test_edges_without_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(edges, none)
    out = toxicity.classify(edges, model)
    assert sorted(out.columns) == ["doc_id", "is_toxic", "lang", "text", "toxicity"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert toxicity.classify(edges.limit(0), model).isEmpty()
    rater = quality.train_quality(edges, none, F.col("quality"))
    rated = quality.rate(edges, rater).collect()
    assert len(rated) == 5 and {r["tail_probability"] for r in rated} == {0.5}
    assert quality.rate(edges.limit(0), rater).isEmpty()


def test_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [toxicity.buckets(t) for t in ("calm talk about birds", "you utter fool", "fool of a fool")] * 8
    model = toxicity._fit(rows, np.array([0, 1, 1] * 8), rng, 60)
    texts = ["birds " * 50 + "fool", "", "x"]
    whole = model.score(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(whole, model.score(texts), atol=1e-5)


def test_language_sets_the_threshold(spark, edges):
    model = toxicity._fit([np.zeros((0, 3), np.int32)], np.zeros(1), np.random.default_rng(0), 0)
    model.thresholds = {"en": 0.7}
    model.threshold = 0.4
    got = {r["lang"]: r["t"] for r in edges.select("lang", toxicity.threshold_of(model, "lang").alias("t")).collect()}
    assert got == {None: 0.4, "en": 0.7, "xx": 0.4}


def test_ordinal_cuts_are_ordered():
    texts = ["bad bad"] * 30 + ["middling text"] * 30 + ["splendid prose"] * 30
    model = quality.fit_ordinal(texts, np.repeat([0, 1, 2], 30))
    assert (np.diff(model.cuts) > 0).all()
    tails = model.tails(["bad bad", "middling text", "splendid prose"])
    assert (np.diff(tails.sum(1)) > 0.3).all() and (tails[:, 0] >= tails[:, 1]).all()


def test_each_language_has_a_threshold_of_its_own(spark):
    tables = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels)
    assert set(model.thresholds) == {"de", "en", "es", "fr"}
    assert all(toxicity.LOWEST <= t <= toxicity.HIGHEST for t in model.thresholds.values())
    got = toxicity.classify(docs, model).join(labels, "doc_id").where("toxic IS NOT NULL")
    held = got.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2").toPandas()
    assert held.is_toxic[held.toxic == 1].mean() > 0.8 and held.is_toxic[held.toxic == 0].mean() < 0.03


def test_thresholds_from_counts():
    toxic, clean = np.zeros(100, int), np.zeros(100, int)
    toxic[[45, 60, 90]], clean[[10, 40]] = (5, 5, 50), (900, 80)
    assert 0.4 < toxicity._best_threshold(toxic, clean) <= 0.45
    # Out of the range nothing is chosen, and without toxic rows it still gives a value in it.
    assert toxicity.LOWEST <= toxicity._best_threshold(np.zeros(100, int), clean) <= toxicity.HIGHEST


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    from layerframe.llm.learning import labelled_sample

    rows = [(i % 40, f"text {i} " * (1 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    first = labelled_sample(docs, labels, F.col("toxic"), most=50, held_out=None)
    again = labelled_sample(docs.repartition(7), labels, F.col("toxic"), most=50, held_out=None)
    assert first[0] == again[0] and len(first[0]) == 50 and first[2] == again[2]
