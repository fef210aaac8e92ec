import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.llm import langid
from layerframe.llm.corpus_queries import op11_langid


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    return langid.train_languages(docs)


def test_held_out_languages(spark, sf_dir):
    got = op11_langid(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert rows and np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_are_calibrated_and_weights_sparse(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, model).where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2").collect()
    right = np.mean([r["lang_pred"] == r["lang"] for r in rows if r["lang"]])
    assert right >= 0.99 and abs(np.mean([r["score"] for r in rows]) - right) < 0.05
    assert len(model.weights) < langid.BUCKETS / 4
    assert (model.weights[:-1] == 0).any() and not model.weights[-1].any()


def test_counts_of_a_text_against_plain_python(monkeypatch):
    def plain(text):
        symbols, blank = [" "], True
        for c in text.lower():
            if c.isalpha():
                symbols.append(c)
            elif not blank:
                symbols.append(" ")
            blank = not c.isalpha()
        return sum(len(symbols) - n for n in range(langid.LONGEST))

    for text in ("Ein Wört,  zwei!", "a", "1a2", "  a  b ", "Ünïcode ß ǅ" * 9):
        # The first blank is context, not a run of its own.
        assert langid.counts_of(text)[1].sum() == plain(text) - 1
    assert langid.counts_of("") is None and langid.counts_of("12 34 !?") is None
    text = "Der Fluß, 12 Brücken; les élèves\n\n et  alors... " * 40
    whole = langid.counts_of(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert all((a == b).all() for a, b in zip(whole, langid.counts_of(text), strict=True))


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 --- !"), (None, "the only one of them"), (5, "the only one of them")]
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert tuple(got[None])[1:] == tuple(got[5])[1:] and got[5]["lang_pred"] in model.langs
    long = docs.limit(1).select(F.lit(9).alias("doc_id"), F.repeat(F.lit("und der die das "), 100_000).alias("text"))
    assert langid.identify(long, model).first()["lang_pred"] == "de"
    assert langid.identify(docs.limit(0), model).isEmpty()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a text", None), (None, "b", "en")], "doc_id long, text string, lang string")
    for table in (docs, docs.limit(0)):
        model = langid.train_languages(table)
        assert model.langs == [] and model.predict("a text") == ("und", 0.0)
    one = spark.createDataFrame([(i, "a text", "xx") for i in range(8)] + [(9, "5", "yy")], "doc_id long, text string, lang string")
    assert langid.train_languages(one, held_out=None).predict("other")[0] == "xx"


def test_training_is_bounded_balanced_and_repeatable(spark):
    rows = [(i, f"word{i % 7} of", "a" if i % 10 else "b") for i in range(4000)] + [(7, "again", "a")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, 200)
    assert len(sample) <= 200 and 40 < sum(lang == "b" for lang, _, _ in sample) < 140
    again = langid.training_sample(docs.repartition(7), 200)
    assert [(a, x.tolist(), n.tolist()) for a, x, n in sample] == [(a, x.tolist(), n.tolist()) for a, x, n in again]
