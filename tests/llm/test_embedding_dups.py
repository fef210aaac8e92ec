import re

import numpy as np
import pytest

from layerframe.llm import embedding_dups

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, threshold=0.9):
    good = {}
    for i, (vec_id, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            good[i] = np.array(v, np.float32).astype(float)
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]):
                cosine = good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j])
                if cosine >= threshold:
                    links[i].add(j)
    group = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        group[i] = min(rows[j][0] for j in seen)
    return {rows[i][0]: (len(links[i]), group[i]) for i in links}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(260):
        spread = 0.05 if i % 3 else 0.3
        rows.append((i, (centres[i % 12] + spread * rng.normal(size=24)).tolist()))
    hot = (rng.normal(size=24)).tolist()
    rows += [(1000 + i, hot) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0, None]), (2004, [float("nan")] * 24),
             (2005, [float("inf")] * 24), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [-x for x in hot])]
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got = {r["vec_id"]: r for r in embedding_dups.near_vectors(table).collect()}
    expected = brute(rows)
    assert set(got) == set(expected)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * sum(n for n, _ in expected.values())
    for vec_id, (n, group) in expected.items():
        assert got[vec_id]["n_links"] <= n
        if vec_id >= 1000:
            assert (got[vec_id]["n_links"], got[vec_id]["component_id"]) == (n, group)
        assert got[vec_id]["kept"] == (got[vec_id]["component_id"] == vec_id)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dups.near_vectors(empty).isEmpty()
    alone = spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in embedding_dups.near_vectors(alone).collect()] == [(7, 0, 7, True)]


def skewed(spark, hot=1_500, pairs=200):
    """A group of distinct vectors that are all linked, and pairs just above the threshold."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=32)
    rows = [(i, (centre + 0.1 * rng.normal(size=32)).tolist()) for i in range(hot)]
    for i in range(pairs):
        a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        rows.append((10_000 + 2 * i, a.tolist()))
        rows.append((10_001 + 2 * i, (0.91 * a + (1 - 0.91**2) ** 0.5 * b).tolist()))
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), hot, pairs


def test_all_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "BLOCK", 64)
    table, hot, _ = skewed(spark, hot=900)
    got = embedding_dups.near_vectors(table).where(f"vec_id < {hot}").collect()
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] < hot and r["component_id"] == 0 for r in got)
    assert found >= 0.999 * hot * (hot - 1)


def test_descent_finds_the_links(spark, monkeypatch):
    table, _, pairs = skewed(spark, hot=100)
    rounds = []
    merge = embedding_dups._merged

    def seen(*args):
        rounds.append(1)
        return merge(*args)

    monkeypatch.setattr(embedding_dups, "_merged", seen)
    got = embedding_dups.near_vectors(table).where("vec_id >= 10000").collect()
    assert sum(r["n_links"] >= 1 for r in got) >= 0.95 * 2 * pairs and len(rounds) > 3
    # The random lists that descent starts from hold few of them.
    monkeypatch.setattr(embedding_dups, "ROUNDS", 0)
    with pytest.raises(RuntimeError, match="links found") as told:
        embedding_dups.near_vectors(table)
    assert float(re.search(r"0\.\d+", str(told.value))[0]) < 0.5


def test_full_lists_of_links_double(spark):
    lists = spark.createDataFrame(
        [(1, [2, 3], [0.99, 0.95], [False, False], 2), (5, [6, 7], [0.99, 0.5], [False, True], 2)],
        embedding_dups._LISTS,
    )
    offers = spark.createDataFrame(
        [(1, [4, 3], [0.97, 0.95]), (5, [8], [0.7]), (5, [8, 7], [0.7, 0.5]), (9, [1], [0.1])],
        "node long, near array<long>, cosine array<float>",
    )
    merged = {r["node"]: r for r in embedding_dups._merged(lists, offers, 0.9, 2).collect()}
    assert {n: (r["near"], r["fresh"], r["most"]) for n, r in merged.items()} == {
        1: ([2, 4], [False, True], 4),  # all beyond the threshold: room for more
        5: ([6, 8], [False, True], 2),
        9: ([1], [True], 2),
    }
    again = {r["node"]: r for r in embedding_dups._merged(embedding_dups._merged(lists, offers, 0.9, 2), offers, 0.9, 2).collect()}
    assert again[1]["near"] == [2, 4, 3] and again[1]["fresh"] == [False, False, True]


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=8).tolist() for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (None, [0.0] * 8), (7, a[:4])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in embedding_dups.near_vectors(table).collect()), key=repr)
    assert got == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (None, 2, 1, False), (None, 1, 1, False), (None, 0, None, True), (7, 0, 7, True)],
        key=repr,
    )


def test_no_row_and_no_table_holds_the_links_of_a_large_group(spark, monkeypatch):
    seen = []
    write = embedding_dups.written_table

    def measured(df, path):
        out = write(df, path)
        sizes = [f"max(size({c}))" for c, t in out.dtypes if t.startswith("array") and c != "codes"]
        seen.append(out.selectExpr("count(*)", *sizes).first())
        return out

    monkeypatch.setattr(embedding_dups, "written_table", measured)
    table, hot, pairs = skewed(spark, hot=900)
    embedding_dups.near_vectors(table)
    assert max(size or 0 for row in seen for size in row[1:]) <= embedding_dups.BLOCK
    assert max(row[0] for row in seen) < hot * (hot - 1) / 4


def test_lists_are_longer_at_first_in_larger_tables(spark, monkeypatch):
    """Otherwise descent fails its audit there, and is done again with doubled lists."""
    assert [embedding_dups._first_length(n) for n in (0, 100, 8_192, 16_384, 51_282, 10**12)] == [16, 16, 16, 20, 26, 64]
    lengths = set()
    merge = embedding_dups._merged

    def seen(lists, offers, threshold, most):
        lengths.add(most)
        return merge(lists, offers, threshold, most)

    monkeypatch.setattr(embedding_dups, "_merged", seen)
    monkeypatch.setattr(embedding_dups, "SMALL", 125)
    table, _, pairs = skewed(spark, hot=100)
    got = embedding_dups.near_vectors(table).where("vec_id >= 10000").collect()
    assert sum(r["n_links"] >= 1 for r in got) >= 0.98 * 2 * pairs
    assert lengths == {24}
