import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from layerframe import fill_defaults, overlay_rows, repeated_keys, require_unique


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def layers(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, x double")
    extra = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "k int, v string, x double")
    return base, extra


@pytest.mark.parametrize("small", [False, True])
def test_right_row_wins_whole_even_with_nulls(layers, small):
    got = overlay_rows(*layers, "k", small_extra=small)
    assert rows(got) == [
        (1, "a", 1.0, "base"),
        (2, None, 9.0, "overridden"),
        (3, "c", 3.0, "added"),
    ]
    assert got.columns == ["k", "v", "x", "origin"]


@pytest.mark.parametrize("small", [False, True])
def test_overlay_laws(layers, small):
    a, b = layers
    empty = a.limit(0)

    def over(x, y):
        return overlay_rows(x, y, "k", small_extra=small).drop("origin")

    c = a.select("k", F.lit("z").alias("v"), "x").where("k = 1")
    assert rows(over(a, empty)) == rows(a)
    assert rows(over(empty, a)) == rows(a)
    assert rows(over(a, a)) == rows(a)
    assert rows(over(over(a, b), c)) == rows(over(a, over(b, c)))


def test_key_only_tables(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(overlay_rows(a, b, "k")) == [(1, "base"), (2, "overridden"), (3, "added")]


def test_types_are_widened_and_columns_must_agree(spark, layers):
    base, _ = layers
    extra = spark.createDataFrame([(5_000_000_000, 7, "n")], "k long, x int, v string")
    got = overlay_rows(base, extra, "k")
    assert got.schema["k"].dataType.simpleString() == "bigint"
    assert (5_000_000_000, "n", 7.0, "added") in rows(got)
    with pytest.raises(ValueError, match="same columns"):
        overlay_rows(base, extra.drop("v"), "k")


@pytest.mark.parametrize("side", [0, 1])
def test_repeated_or_null_keys_are_rejected(spark, layers, side):
    for bad in [(2, "again", 0.0), (None, "none", 0.0)]:
        tables = list(layers)
        tables[side] = tables[side].union(
            spark.createDataFrame([bad], "k int, v string, x double")
        )
        with pytest.raises(PySparkException, match="NULL or repeated"):
            overlay_rows(*tables, "k").collect()
    overlay_rows(*tables, "k", check=False).collect()


def test_unchecked_left_duplicates_do_not_multiply_with_small_extra(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    extra = spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string")
    got = overlay_rows(base, extra, "k", small_extra=True, check="right")
    assert rows(got) == [(1, "c", "overridden"), (1, "c", "overridden"), (2, "d", "added")]


def test_where_reaches_both_scans(spark, layers, tmp_path):
    paths = []
    for i, table in enumerate(layers):
        paths.append(str(tmp_path / str(i)))
        table.write.parquet(paths[-1])
    a, b = (spark.read.parquet(p) for p in paths)
    got = overlay_rows(a, b, "k", where=F.col("k") == 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(k,2)") == 2
    assert rows(got) == [(2, None, 9.0, "overridden")]
    got = overlay_rows(a, b, "k", small_extra=True, check="right").where("k = 2")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # all but a key-only read of the small side
    assert plan.count("EqualTo(k,2)") == plan.count("FileScan parquet") - 1 == 4
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("small", [False, True])
def test_columns_not_asked_for_are_not_read(spark, layers, tmp_path, small):
    layers[0].write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    got = overlay_rows(base, layers[1], "k", small_extra=small).select("k", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "k:int,v:string,x" not in plan and "k:int,v:string" in plan


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k int")
    assert rows(repeated_keys(df, "k")) == [(1, 2), (None, 2)]
    plan = repeated_keys(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_merge_shuffles_each_side_once(spark, layers, tmp_path):
    paths = []
    for i, table in enumerate(layers):
        paths.append(str(tmp_path / str(i)))
        table.write.parquet(paths[-1])
    a, b = (spark.read.parquet(p) for p in paths)
    plan = overlay_rows(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 2
    assert plan.count("Sort [") == 2


def test_require_unique_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string")
    assert rows(require_unique(df, "k")) == rows(df)
    assert rows(require_unique(df, ["k", "v"])) == rows(df)
    with pytest.raises(PySparkException, match="thing: key is NULL or repeated: x"):
        require_unique(df, "v", "thing").collect()


@pytest.fixture
def grid(spark):
    present = spark.createDataFrame(
        [("p", "a", "mine", 1), ("p", "b", None, None), ("q", "other", "kept", 2)],
        "profile string, item string, content string, n int",
    )
    entities = spark.createDataFrame([("p",), ("q",), ("r",)], "profile string")
    return present, entities


EXPECTED = [
    ("p", "a", "mine", 1, False),
    ("p", "b", None, None, False),
    ("p", "c", "blank c", None, True),
    ("q", "a", "blank a", None, True),
    ("q", "b", "blank b", None, True),
    ("q", "c", "blank c", None, True),
    ("q", "other", "kept", 2, False),
    ("r", "a", "blank a", None, True),
    ("r", "b", "blank b", None, True),
    ("r", "c", "blank c", None, True),
]


@pytest.mark.parametrize("form", ["list", "table"])
def test_fill_by_absence_only(spark, grid, form):
    present, entities = grid
    items = ["a", "b", "c"]
    if form != "list":
        items = spark.createDataFrame([(i,) for i in [*items, "a", None]], "item string")
    got = fill_defaults(
        present,
        entities,
        items,
        entity="profile",
        item="item",
        defaults={"content": F.concat(F.lit("blank "), "item")},
    )
    assert rows(got) == sorted(EXPECTED, key=repr)
    again = fill_defaults(
        got.drop("filled"), entities, items, entity="profile", item="item", defaults={}
    )
    assert rows(again.where("filled")) == []


def test_fill_empty_inputs(spark, grid):
    present, entities = grid
    args = {"entity": "profile", "item": "item", "defaults": {"n": 0}}
    assert fill_defaults(present, entities, [], **args).where("filled").isEmpty()
    assert fill_defaults(present, entities.limit(0), ["a"], **args).where("filled").isEmpty()
    filled = fill_defaults(present.limit(0), entities, ["a"], **args)
    assert rows(filled) == [(p, "a", None, 0, True) for p in "pqr"]
    assert filled.schema["n"].dataType.simpleString() == "int"


def test_fill_rejects_repeated_entities(grid):
    present, entities = grid
    with pytest.raises(PySparkException, match="entities"):
        fill_defaults(
            present, entities.union(entities), ["a"], entity="profile", item="item", defaults={}
        ).collect()


@pytest.mark.parametrize("n", [3, 1_100])
@pytest.mark.parametrize("form", ["list", "table"])
def test_fill_casts_items_before_anything_else(spark, n, form):
    held = spark.createDataFrame([("p", 7, "x"), ("q", 1, "y")], "entity string, item int, value string")
    entities = spark.createDataFrame([("p",), ("q",)], "entity string")
    items = [str(i) for i in range(n)] + ["007", "7"]
    if form == "table":
        items = spark.createDataFrame([(i,) for i in items], "item string")
    got = fill_defaults(
        held, entities, items, entity="entity", item="item", defaults={"value": "new"}
    )
    pairs = [(r["entity"], r["item"]) for r in got.collect()]
    wanted = {*range(n), 7}
    assert sorted(pairs) == sorted({(e, i) for e in "pq" for i in wanted})


@pytest.mark.parametrize("small", [False, True])
def test_repeated_base_keys_fail_in_both_forms(spark, small):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    extra = spark.createDataFrame([(2, "x")], "k int, v string")
    with pytest.raises(PySparkException, match="left side"):
        overlay_rows(base, extra, "k", small_extra=small).collect()
    with pytest.raises(PySparkException, match="right side"):
        overlay_rows(extra, base, "k", small_extra=small).collect()
    assert overlay_rows(base, extra, "k", small_extra=small, check="right").count() >= 3
