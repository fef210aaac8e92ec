import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from layerframe.llm import importance


def plain_features(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000), np.zeros(10_000)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in plain_features(text)[1]:
                counts[bucket(f)] += 1
    all_s, all_t = s.sum(), t.sum()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, features = plain_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        name = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(features), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def random_docs(seed, n=700):
    rng = random.Random(seed)
    words = ["Ab", "ñu", "9x", "tail", "of", "KK", "İs"]
    docs = [(rng.choice([None, -5, rng.randrange(10**12), rng.randrange(50)]), "-".join(rng.choices(words, k=rng.randrange(0, 60)))) for _ in range(n)]
    return docs + [(3, None), (4, ""), (5, "!?"), (6, "one")] + docs[:40] + [(77, "tail of " * 15)] * 30


def drawn(spark, docs, target):
    table = spark.createDataFrame([(*d, 1.5, 2) for d in docs], "doc_id long, text string, score double, rank int")
    goal = spark.createDataFrame([(t, 0) for t in target], "text string, weight int")
    return sorted((tuple(r) for r in importance.draw(table, goal).collect()), key=repr)


def test_against_plain_python(spark, monkeypatch):
    target = ["tail of tail ab 9x", None, "", "of of of"]
    docs = random_docs(1)
    expected = plain_draw(docs, target)
    assert drawn(spark, docs, target) == expected and any(r[4] for r in expected)
    # Texts in small pieces, many small blocks and short digits change nothing.
    for name, value in (("PIECE", 1), ("LEAST_BLOCK", 12), ("DIGIT_BITS", 11), ("BINS", 5)):
        monkeypatch.setattr(importance, name, value)
    assert drawn(spark, docs, target) == expected
    assert drawn(spark, docs, [None]) == plain_draw(docs, [None])


def test_features_in_pieces(monkeypatch):
    texts = ["", "a", "a b", "a b c d", "ab-cd ef" * 20, "é" * 50, " x  y ", "long" * 30 + " b c"]
    for size in (1, 2, 5, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", size)
        for text in texts:
            got = [h for runs in importance.feature_hashes(text.encode()) for r in runs for h in r.tolist()]
            assert sorted(got) == sorted(zlib.crc32(f.encode()) for f in plain_features(text)[1])


def test_radix_ranks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(1 << 40), rng.randrange(9)) for _ in range(2_000)] + [(1, 5, 5)] * 50
    table = spark.createDataFrame(rows, "a long, b long, other long")
    for block, bits in ((4_096, 16), (200, 11)):
        monkeypatch.setattr(importance, "LEAST_BLOCK", block)
        monkeypatch.setattr(importance, "DIGIT_BITS", bits)
        got = sorted(importance.radix_ranks(table, ["a", "b"]).collect(), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
        assert [(r["a"], r["b"]) for r in got] == sorted((a, b) for a, b, _ in rows)
        assert sorted(tuple(r)[:3] for r in got) == sorted(rows)
    assert importance.radix_ranks(table.limit(0), ["a", "b"]).isEmpty()


def test_no_task_gets_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(importance, "LEAST_BLOCK", 100)
    rows = spark.range(4_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    ranked = importance.radix_ranks(rows, ["a", "b"])
    blocks = ranked.groupBy(F.floor((F.col("rank") - 1) / 100)).count().collect()
    assert len(blocks) == 40 and max(r["count"] for r in blocks) == 100


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 30), (2, "w " * 19), (3, None)], "doc_id long, text string")
    target = spark.createDataFrame([("w",)], "text string")
    got = importance.draw(docs, target).collect()
    assert len(got) == 3 and all(r["rank"] is None for r in got)
    assert importance.draw(docs.limit(0), target).isEmpty()
    assert importance.draw(docs, target.limit(0)).count() == 3
