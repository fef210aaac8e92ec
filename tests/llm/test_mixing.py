from collections import defaultdict

from layerframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by reshare rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and free:
        total, part = sum(weight[s] for s in free), left
        left = 0.0
        for s in list(free):
            target[s] += part * weight[s] / total
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 7}", "clash") for i in range(700)]
    rows += [(1000 + i, "one two three", "tiny", None) for i in range(3)]
    rows += [(2000, None, None, None), (2001, "a b", None, None), (None, "x", "s1", None), (5, "w", "empty", None)]
    rows += [(3000, "", "blank", None), (7, "same", "s1", None), (7, "same", "s1", None), (9, "w " * 90_000, "s2", None)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    target = fill(sizes)
    for r in out:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * largest[s] + 0.1 * target[s]
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_documents_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}", "kept") for i in range(50)], SCHEMA)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("size = 'kept'").count() == mixed.count() > 30
    assert mixing.mix(docs.limit(0)).isEmpty() and mixing.mixed_documents(docs.limit(0)).isEmpty()


def test_no_python_in_the_plan(spark, table):
    plan = mixing.mix(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
