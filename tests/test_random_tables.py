"""Operators on random tables against the same rules in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from layerframe import (
    active_state,
    exists_guard,
    fill_defaults,
    inventory,
    managed_remove,
    mark_active,
    overlay_rows,
    tag_known,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expect(values):
    return sorted(values, key=repr)


@pytest.fixture(params=[1, 2, 3])
def rng(request):
    return random.Random(request.param)


def some(rng, n, share=0.6):
    return [i for i in range(n) if rng.random() < share]


@pytest.mark.parametrize("small", [False, True])
def test_overlay_rows(spark, rng, small):
    def table(side):
        return {
            (i % 7, f"k{i}"): (rng.choice([None, side, "x"]), rng.choice([None, 1, 2]))
            for i in some(rng, 80)
        }

    base, extra = table("base"), table("extra")
    schema = "a int, b string, v string, n int"
    frames = [spark.createDataFrame([(*k, *v) for k, v in t.items()], schema) for t in (base, extra)]
    expected = []
    for key in base.keys() | extra.keys():
        origin = "base" if key not in extra else "overridden" if key in base else "added"
        expected.append((*key, *({**base, **extra}[key]), origin))
    assert rows(overlay_rows(*frames, ["a", "b"], small_extra=small)) == expect(expected)


def test_fill_defaults(spark, rng):
    items = [f"i{n}" for n in range(6)]
    present = [
        (e, i, rng.choice([None, "", "text"]))
        for e in range(30)
        for i in [*items, "extra"]
        if rng.random() < 0.5
    ]
    entities = some(rng, 40)
    got = fill_defaults(
        spark.createDataFrame(present, "e int, item string, content string"),
        spark.createDataFrame([(e,) for e in entities], "e int"),
        items,
        entity="e",
        item="item",
        defaults={"content": "blank"},
    )
    held = {(e, i) for e, i, _ in present}
    blanks = [(e, i, "blank", True) for e in entities for i in items if (e, i) not in held]
    assert rows(got) == expect([(*row, False) for row in present] + blanks)


def test_managed_remove(spark, rng):
    current = [
        (rng.choice([None, *range(6)]), n, rng.choice([None, "us", "them"])) for n in range(200)
    ]
    scope = [rng.choice([None, *range(6)]) for _ in range(4)]
    got = managed_remove(
        spark.createDataFrame(current, "k int, n int, owner string"),
        spark.createDataFrame([(s,) for s in scope], "k int"),
        "k",
        F.col("owner") == "us",
    )
    gone = {s for s in scope if s is not None}
    assert rows(got) == expect([r for r in current if not (r[2] == "us" and r[0] in gone)])


def test_state_and_flags(spark, rng):
    log = [
        (rng.randrange(15), rng.choice([None, "off", "a", "b", "c"]), rng.randrange(20), n)
        for n in range(150)
    ]
    last = {}
    for scope, value, ts, n in sorted(log, key=lambda r: (r[2], r[3])):
        last[scope] = value
    alive = {s: v for s, v in last.items() if v not in (None, "off")}
    frame = spark.createDataFrame(log, "scope int, value string, ts int, n int")
    state = active_state(frame, "scope", "value", ["ts", "n"], tombstone="off")
    assert rows(state) == expect(alive.items())
    names = [(s, v) for s in range(20) for v in "abc"]
    flags = mark_active(
        spark.createDataFrame(names, "scope int, name string"), state, "scope", "name", "value"
    )
    assert rows(flags) == expect([(s, v, alive.get(s) == v) for s, v in names])


@pytest.mark.parametrize("salts", [1, 5])
def test_guards_and_listing(spark, rng, salts):
    # two thirds of the rows have the same name
    df = [(rng.choice(["hot", "hot", rng.randrange(20)]), n) for n in range(150)]
    df = [(str(name), n) for name, n in df]
    registry = ["hot"] * 30 + [str(i) for i in some(rng, 20)]
    frame = spark.createDataFrame(df, "name string, n int")
    names = spark.createDataFrame([(r,) for r in registry], "name string")
    found, missing = exists_guard(frame, names, "name", salts=salts)
    assert rows(found) == expect([r for r in df if r[0] in registry])
    assert rows(missing) == expect([r for r in df if r[0] not in registry])
    tagged = tag_known(frame, names, "name", salts=salts)
    assert rows(tagged) == expect([(*r, r[0] in registry) for r in df])
    counts = {name: sum(r[0] == name for r in df) for name, _ in df}
    listed = inventory(frame, "name", path="n", salts=salts, ordered=True)
    assert [tuple(r) for r in listed.collect()] == [(a, counts[a], n) for a, n in sorted(df)]
