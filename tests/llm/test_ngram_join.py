import random

import numpy as np

from layerframe.llm import ngram_join

SCHEMA = "doc_id long, text string, node string"


def shingles(text):
    words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        {j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9}
        for i, a in enumerate(sets)
    ]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc_id, len(links[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 30 if i < 2 else 4])):
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(changed)))
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows += [(len(rows) + i, shared + " " + " ".join(rng.choices(vocabulary, k=40))) for i in range(30)]
    rows += [(500 + i, "the very same text again and again") for i in range(25)]
    rows += [(600, None), (601, ""), (602, " \n "), (603, "W1 w2\nw3 W4 w5 w6"), (604, "w1 w2 w3 w4  w5 w6")]
    long = " ".join(rng.choices(vocabulary, k=30_000))
    rows += [(700, long), (701, long + " end"), (None, "only one of it"), (None, "w1 w2 w3 w4 w5 w6")]
    rows += [(500, "another text under a used id, five and more")] + rows[:2]
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = ngram_join.jaccard_join(table).collect()
    assert sorted(((r["doc_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute(rows)
    for r in got:
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_empty_table(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], SCHEMA)).isEmpty()
    blank = spark.createDataFrame([(1, "", None), (2, None, None)], SCHEMA)
    assert sorted(tuple(r) for r in ngram_join.jaccard_join(blank).collect()) == [
        (1, 1, 0, 1, True), (2, 2, 0, 2, True)
    ]


def test_minhash_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    rates = []
    for _ in range(60):
        common = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
        rates.append((ngram_join.minhashes(a) == ngram_join.minhashes(b)).mean())
    assert abs(np.mean(rates) - 0.8) < 0.02


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for n in (16, 48, 96):
        least = ngram_join.least_matches(n)
        assert 0 < least < 0.75 * n
        assert (rng.binomial(n, 0.8, 200_000) >= least).mean() > 0.9999
