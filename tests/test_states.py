import random

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from layerframe import (
    apply_to_state,
    create_state,
    managed_apply,
    managed_remove,
    owner_of,
    read_state,
    remove_from_state,
    state_version,
)

SCHEMA = "k long, v string, owner string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def state(spark, tmp_path):
    base = spark.range(2_000).selectExpr("id AS k", "concat('v', id) AS v", "if(id % 3 = 0, 'us', 'them') AS owner")
    create_state(base, str(tmp_path / "state"), "k", 400)
    return str(tmp_path / "state")


def test_a_change_reads_and_writes_the_buckets_of_its_keys(spark, state):
    before = read_state(spark, state)
    held = rows(before)
    incoming = spark.createDataFrame([(3, "n", "us"), (4, "n", "us"), (9_999, "n", "us")], SCHEMA)
    told = apply_to_state(spark, state, incoming.selectExpr("int(k) AS k", "v", "owner"), "k", F.col("owner") == "us")
    assert rows(told) == [(3, "replaced"), (4, "conflict"), (9999, "inserted")]
    expected = managed_apply(before, incoming, "k", F.col("owner") == "us").drop("outcome")
    assert rows(read_state(spark, state)) == rows(expected)
    old, new = state_version(spark, state, 0), state_version(spark, state)
    changed = {b for b in new.folders if new.folders[b] != old.folders.get(b)}
    assert 1 <= len(changed) <= 3 and len(old.folders) > 300
    # Less than one file in a hundred is opened for it.
    plan = old.rows(spark, changed)
    assert len(plan.inputFiles()) <= 3 < len(read_state(spark, state, 0).inputFiles()) / 100
    # Who reads by the version before sees what was.
    assert rows(read_state(spark, state, 0)) == held


def test_removal_and_buckets_left_empty(spark, tmp_path):
    root = str(tmp_path / "s")
    base = spark.createDataFrame([(1, "a", "us"), (2, "b", "them"), (3, "c", "us")], SCHEMA)
    create_state(base, root, ["k"], 64)
    scope = spark.createDataFrame([(1,), (2,), (77,)], "k long")
    after = remove_from_state(spark, root, scope, "k", F.col("owner") == "us")
    assert rows(read_state(spark, root)) == rows(managed_remove(base, scope, "k", F.col("owner") == "us"))
    assert after.version == 1 and len(after.folders) == 2
    remove_from_state(spark, root, base.select("k"), "k", F.lit(True))
    assert read_state(spark, root).isEmpty() and read_state(spark, root).columns == ["k", "v", "owner"]
    apply_to_state(spark, root, base, "k", F.lit(True))
    assert rows(read_state(spark, root)) == rows(base)
    apply_to_state(spark, root, base.limit(0), "k", F.lit(True))
    assert rows(read_state(spark, root)) == rows(base) and state_version(spark, root).version == 4


def test_errors(spark, state):
    base = read_state(spark, state)
    with pytest.raises(AnalysisException, match="already exists"):
        create_state(base, state, "k", 4)
    twice = spark.createDataFrame([(1, "a", "us"), (1, "b", "us")], SCHEMA)
    with pytest.raises(PySparkException, match="repeated"):
        apply_to_state(spark, state, twice, "k", F.lit(True))
    with pytest.raises(ValueError, match="laid out"):
        remove_from_state(spark, state, base.select("owner"), "owner", F.lit(True))
    assert state_version(spark, state).version == 0


def test_of_two_changes_at_once_one_is_told(spark, state, monkeypatch):
    from layerframe.sources import states

    real, incoming = states.managed_apply, spark.createDataFrame([(1, "x", "us")], SCHEMA)

    def meanwhile(*args, **kwargs):
        monkeypatch.setattr(states, "managed_apply", real)
        apply_to_state(spark, state, incoming.withColumn("k", F.lit(5).cast("long")), "k", F.lit(True))
        return real(*args, **kwargs)

    monkeypatch.setattr(states, "managed_apply", meanwhile)
    with pytest.raises(AnalysisException, match="changed meanwhile"):
        apply_to_state(spark, state, incoming, "k", F.lit(True))
    values = {r.k: r.v for r in read_state(spark, state).where("k IN (1, 5)").collect()}
    assert values == {1: "v1", 5: "x"}


def test_owner_of_the_longest_root(spark):
    rng = random.Random(1)
    parts = ["a", "b", "ab", ""]
    paths = ["/".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(300)] + ["/old/p/f", "/new/p/f", "/old", None]
    roots = {"/old": "us", "/new/": "us", "a": "A", "a/b": "B", "ab": "C", "a/b/a/b": "D", "": "root"}

    def plain(path):
        found = [r.rstrip("/") for r in roots if path is not None and path.startswith(r.rstrip("/") + "/")]
        return next((o for r, o in roots.items() if found and r.rstrip("/") == max(found, key=len)), None)

    table = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(paths)], "n int, path string, owner string")
    owned = owner_of(table, spark.createDataFrame(list(roots.items()), "root string, owner string"), "path")
    assert {r.n: r.owner for r in owned.collect()} == {i: plain(p) for i, p in enumerate(paths)}
    assert owned.columns == ["n", "path", "owner"]
    plan = owned._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    repeated = spark.createDataFrame([("/a", "x"), ("/a/", "y")], "root string, owner string")
    with pytest.raises(PySparkException, match="roots"):
        owner_of(table, repeated, "path").collect()
