import hashlib
import math
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from layerframe.llm import imatch
from layerframe.llm import neighbours
from layerframe.llm.queries import op4_imatch


def edited(text, following):
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def test_query_against_plain_python(spark, sf_dir, table):
    texts = sorted(((r["doc_id"], r["text"] or "") for r in table("documents").collect()), reverse=True)
    got = {r["doc_id"]: r for r in op4_imatch(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    prints = {}
    for (doc_id, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited(text, following).encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    near = [r["near_edited"] for r in got.values()]
    away = [r["near_next"] for r in got.values()]
    assert statistics.mean(near) > 0.25 > 0.1 > statistics.mean(away)


def plain_terms(spark, texts):
    """The hash of every word, and the term set of each text: of the lexicon, else all words."""
    words = {t: {w for w in re.split(r"[\W_]+", (t or "").lower()) if w} for t in texts}
    every = sorted(set().union(*words.values()))
    table = spark.createDataFrame([(w,) for w in every], "word string")
    hashes = {r["word"]: r["h"] for r in table.select("word", imatch.term_of(F.col("word")).alias("h")).collect()}
    return words, hashes


def plain_levels(terms):
    """Terms by subset at each level from the text's own on."""
    level = max((len(terms) >> imatch.LEVEL_SHIFT).bit_length() - 1, 0)
    while level and not any(t & ((1 << level) - 1) == 0 for t in terms):
        level -= 1
    out = {}
    for at in range(level, level + imatch.LEVELS):
        out[at] = [frozenset() for _ in range(imatch.SUBSETS)]
        for t in terms:
            if t & ((1 << at) - 1) == 0:
                out[at][(t >> 40) % imatch.SUBSETS] |= {t}
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    one, two = plain_levels(a), plain_levels(b)
    at = max(min(one), min(two))
    none = [frozenset()] * imatch.SUBSETS
    pairs = [(x, y) for x, y in zip(one.get(at, none), two.get(at, none)) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def test_fingerprints_and_likeness_against_plain_python(spark, sf_dir, table):
    texts = sorted(((r["doc_id"], r["text"] or "") for r in table("documents").collect()), reverse=True)
    both = [(i, t, edited(t, n), n) for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1])]
    words, hashes = plain_terms(spark, {t for _, *three in both for t in three})
    counts = Counter(w for _, t in texts for w in words[t])
    band = {
        w for w, n in counts.items()
        if n > 1 and math.exp(-imatch.HIGHEST_IDF) * len(texts) <= n <= math.exp(-imatch.LOWEST_IDF) * len(texts)
    }
    terms = {t: frozenset(hashes[w] for w in (ws & band or ws)) for t, ws in words.items()}
    got = {r["doc_id"]: r for r in op4_imatch(spark, sf_dir).collect()}
    prints = {}
    for doc_id, text, changed, following in both:
        row = got[doc_id]
        assert row["near_edited"] == pytest.approx(plain_likeness(terms[text], terms[changed]))
        assert row["near_next"] == pytest.approx(plain_likeness(terms[text], terms[following]))
        for t, p in ((text, row["fingerprint"]), (changed, row["edited_fingerprint"])):
            assert prints.setdefault(terms[t], p) == p
    assert len(set(prints.values())) == len(prints)


def test_texts_of_very_different_lengths(spark):
    rows = [("short", " ".join(f"w{i}" for i in range(100))), ("long", " ".join(f"w{i}" for i in range(1_000)))]
    docs = spark.createDataFrame(rows, "key string, text string")
    terms = imatch.lexicon(docs.union(docs), lowest=0.0)
    prints = {r["key"]: r["text_fingerprint"] for r in imatch.fingerprints(docs, ["key"], ["text"], terms).collect()}
    assert int(prints["long"].split("|")[0]) - int(prints["short"].split("|")[0]) >= 2
    pair = spark.createDataFrame([(prints["short"], prints["long"])], "a string, b string")
    there, back = pair.select(imatch.likeness(F.col("a"), F.col("b")), imatch.likeness(F.col("b"), F.col("a"))).first()
    assert there == back > 0


def test_next_texts_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_A_BUCKET", 3)
    rows = [(i * i % 41, f"t{i}") for i in range(20)] + [(None, "n"), (7, None), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r for r in neighbours.with_next_text(docs).collect() if not r["extra"]]
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows), reverse=True)
    expected = [(t, n) for (_, t), (_, n) in zip(order, order[1:] + order[:1])]
    assert sorted((r["text"], r["next_text"]) for r in out) == sorted(expected)


def test_edges(spark):
    long = " ".join(f"w{i % 900}" for i in range(60_000))
    rows = [("a", None), ("b", ""), ("c", "... !"), ("d", "one"), ("e", "one"), ("f", long), ("g", long + " end")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "key string, text string, term string")
    terms = imatch.lexicon(docs, lowest=0.0)
    out = imatch.fingerprints(docs, ["key"], ["text"], terms)
    prints = {r["key"]: r["text_fingerprint"] for r in out.collect()}
    assert len(prints) == 7 and prints["a"] == prints["b"] == prints["c"] and prints["d"] == prints["e"]
    pair = spark.createDataFrame([(prints["f"], prints["g"], prints["d"])], "a string, b string, c string")
    (row,) = pair.select(
        imatch.likeness(F.col("a"), F.col("b")).alias("near"), imatch.likeness(F.col("a"), F.col("c")).alias("far")
    ).collect()
    assert row["near"] > 0.7 and row["far"] == 0
    assert imatch.fingerprints(docs.limit(0), ["key"], ["text"], imatch.lexicon(docs.limit(0))).isEmpty()
    assert op_is_native(out)


def test_long_texts_of_few_distinct_words(spark):
    rows = [(i, " ".join(f"w{i}x{j % 8}" for j in range(4_000))) for i in range(30)]
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(30)]
    docs = spark.createDataFrame(rows, "key long, text string")
    for terms in (imatch.lexicon(docs, lowest=0.0), imatch.lexicon(docs.limit(0))):
        out = imatch.fingerprints(docs, ["key"], ["text"], terms)
        prints = {r["key"]: r["text_fingerprint"] for r in out.collect()}
        assert all(p.split("|")[2].strip(",") for p in prints.values())
        assert len(set(prints.values())) == 30
        assert all(prints[i] == prints[100 + i] for i in range(30))


def op_is_native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))
