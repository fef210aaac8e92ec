import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from layerframe import managed_apply, managed_remove, removable, switch_owner

SCHEMA = "scope string, key string, value string, owner string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ours():
    return F.col("owner") == "us"


@pytest.fixture
def current(spark):
    return spark.createDataFrame(
        [
            ("s", "own", "old", "us"),
            ("s", "foreign", "real", "them"),
            ("s", "nobody", "real", None),
            ("s", "idle", "stays", "us"),
            ("t", "own", "other scope", "us"),
        ],
        SCHEMA,
    )


@pytest.fixture
def incoming(spark):
    return spark.createDataFrame(
        [("s", k, "new", "us") for k in ("own", "foreign", "nobody", "free")], SCHEMA
    )


@pytest.mark.parametrize("small", [False, True])
def test_apply_outcomes(current, incoming, small):
    got = managed_apply(current, incoming, ["scope", "key"], ours(), small_incoming=small)
    assert rows(got) == sorted(
        [
            ("s", "own", "new", "us", "replaced"),
            ("s", "foreign", "real", "them", "conflict"),
            ("s", "nobody", "real", None, "conflict"),
            ("s", "free", "new", "us", "inserted"),
            ("s", "idle", "stays", "us", "kept"),
            ("t", "own", "other scope", "us", "kept"),
        ],
        key=repr,
    )


@pytest.mark.parametrize("small", [False, True])
def test_apply_empty_sides(current, incoming, small):
    keys = ["scope", "key"]
    nothing = managed_apply(current, incoming.limit(0), keys, ours(), small_incoming=small)
    assert rows(nothing.drop("outcome")) == rows(current)
    assert {r.outcome for r in nothing.collect()} == {"kept"}
    fresh = managed_apply(current.limit(0), incoming, keys, ours(), small_incoming=small)
    assert rows(fresh.drop("outcome")) == rows(incoming)
    assert {r.outcome for r in fresh.collect()} == {"inserted"}


def test_apply_all_in_conflict(current, incoming):
    nobody = F.lit(False)
    got = managed_apply(current, incoming.where("key <> 'free'"), ["scope", "key"], nobody)
    assert rows(got.drop("outcome")) == rows(current)


def test_apply_where_limits_both_sides(current, incoming):
    got = managed_apply(
        current, incoming, ["scope", "key"], ours(), where=F.col("key") == "free"
    )
    assert rows(got) == [("s", "free", "new", "us", "inserted")]


def test_apply_rejects_repeated_keys(current, incoming):
    with pytest.raises(PySparkException, match="repeated"):
        managed_apply(
            current, incoming.union(incoming), ["scope", "key"], ours()
        ).collect()


def test_remove_needs_scope_and_ownership(spark, current):
    scope = spark.createDataFrame(
        [("s", "own"), ("s", "own"), ("s", "foreign"), ("s", "nobody"), ("s", "absent"), (None, None)],
        "scope string, key string",
    )
    keys = ["scope", "key"]
    left = managed_remove(current, scope, keys, ours())
    gone = removable(current, scope, keys, ours())
    assert rows(gone) == [("s", "own", "old", "us")]
    assert rows(left.union(gone)) == rows(current)
    assert rows(managed_remove(current, scope.limit(0), keys, ours())) == rows(current)
    by_scope = managed_remove(current, scope.select("scope"), "scope", ours())
    assert [r[1] for r in rows(by_scope)] == ["foreign", "nobody", "own"]


def test_remove_undoes_apply_without_conflicts(spark):
    before = spark.createDataFrame([("s", "theirs", "v", "them")], SCHEMA)
    incoming = spark.createDataFrame([("s", "a", "n", "us"), ("t", "b", "n", "us")], SCHEMA)
    keys = ["scope", "key"]
    after = managed_apply(before, incoming, keys, ours()).drop("outcome")
    assert rows(managed_remove(after, incoming, keys, ours())) == rows(before)


def test_apply_twice_is_apply_once(current, incoming):
    keys = ["scope", "key"]
    once = managed_apply(current, incoming, keys, ours()).drop("outcome")
    assert rows(managed_apply(once, incoming, keys, ours()).drop("outcome")) == rows(once)


def test_switch(spark, current):
    registry = spark.createDataFrame([("us",), ("new",)], "owner string")
    incoming = spark.createDataFrame(
        [("s", "own", "n", "new"), ("s", "foreign", "n", "new")], SCHEMA
    )
    scope = spark.createDataFrame([("s", "own"), ("s", "idle")], "scope string, key string")
    args = {"scope": scope, "scope_keys": ["scope", "key"], "registry": registry}
    got = switch_owner(current, incoming, ["scope", "key"], ours(), **args)
    assert rows(got) == sorted(
        [
            ("s", "own", "n", "new", "inserted"),
            ("s", "foreign", "real", "them", "conflict"),
            ("s", "nobody", "real", None, "kept"),
            ("t", "own", "other scope", "us", "kept"),
        ],
        key=repr,
    )
    unknown = incoming.withColumn("owner", F.lit("nonexistent"))
    with pytest.raises(PySparkException, match="owner not found: nonexistent"):
        switch_owner(current, unknown, ["scope", "key"], ours(), **args).collect()


def test_apply_against_plain_python(spark):
    keys = [f"k{i}" for i in range(16)]
    held = {k: ("us" if i & 2 else "them") for i, k in enumerate(keys) if i & 1}
    came = {k for i, k in enumerate(keys) if i & 4}
    current = spark.createDataFrame([("s", k, "old", o) for k, o in held.items()], SCHEMA)
    incoming = spark.createDataFrame([("s", k, "new", "us") for k in came], SCHEMA)
    expected = set()
    for k in itertools.chain(set(held) | came):
        if k not in came:
            expected.add((k, "old", "kept"))
        elif k not in held:
            expected.add((k, "new", "inserted"))
        elif held[k] == "us":
            expected.add((k, "new", "replaced"))
        else:
            expected.add((k, "old", "conflict"))
    got = managed_apply(current, incoming, ["scope", "key"], ours())
    assert {(r.key, r.value, r.outcome) for r in got.collect()} == expected
