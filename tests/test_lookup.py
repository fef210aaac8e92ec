import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from layerframe import (
    active_state,
    alias_lookup,
    exists_guard,
    inventory,
    inventory_counts,
    lookup_join,
    managed_remove,
    mark_active,
    require_known,
    tag_known,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_active_state(spark):
    log = spark.createDataFrame(
        [
            ("a", "one", 1, 1),
            ("a", "two", 2, 1),
            ("b", "one", 5, 1),
            ("b", None, 5, 2),
            ("c", "off", 3, 1),
            ("c", "one", 1, 9),
            ("d", "tie2", 1, 1),
            ("d", "tie1", 1, 1),
        ],
        "scope string, value string, ts int, id int",
    )
    got = active_state(log, "scope", "value", ["ts", "id"], tombstone="off")
    assert rows(got) == [("a", "two"), ("d", "tie2")]
    assert ("c", "off") in rows(active_state(log, "scope", "value", ["ts", "id"]))
    assert active_state(log.limit(0), "scope", "value", "ts").isEmpty()


def test_active_state_combines_before_the_shuffle(spark):
    log = spark.range(10).selectExpr("id % 2 AS scope", "id AS value", "id AS ts")
    plan = active_state(log, "scope", "value", "ts")._jdf.queryExecution().executedPlan()
    assert plan.toString().index("partial_max") > plan.toString().index("Exchange")


@pytest.mark.parametrize("salts", [1, 4])
def test_mark_active(spark, salts):
    names = spark.createDataFrame(
        [("s", "a"), ("s", "b"), ("t", "a"), ("u", None)], "scope string, name string"
    )
    state = spark.createDataFrame([("s", "b"), ("u", "a")], "scope string, value string")
    got = mark_active(names, state, "scope", "name", "value", salts=salts)
    assert rows(got) == sorted(
        [("s", "a", False), ("s", "b", True), ("t", "a", False), ("u", None, False)], key=repr
    )
    none_active = mark_active(names, state.limit(0), "scope", "name", "value")
    assert {r.is_active for r in none_active.collect()} == {False}
    with pytest.raises(PySparkException, match="state"):
        mark_active(names, state.union(state), "scope", "name", "value").collect()


@pytest.mark.parametrize("salts", [1, 4])
def test_guards(spark, salts):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "name string, n int")
    registry = spark.createDataFrame([("a",), ("a",), ("c",)], "name string")
    found, missing = exists_guard(df, registry, "name", salts=salts)
    assert [r.n for r in found.orderBy("n").collect()] == [1, 2]
    assert [r.n for r in missing.orderBy("n").collect()] == [3, 4]
    tagged = tag_known(df, registry, "name", salts=salts)
    assert {r.n: r.known for r in tagged.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_require_known(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "name string, n int")
    registry = spark.createDataFrame([("a",), ("a",)], "name string")
    assert rows(require_known(df, registry, "name")) == rows(df)
    for bad in ["nonexistent", None]:
        more = df.union(spark.createDataFrame([(bad, 3)], "name string, n int"))
        with pytest.raises(PySparkException, match=f"profile not found: {bad or 'NULL'}"):
            require_known(more, registry, "name", "profile").collect()


@pytest.mark.parametrize("form", ["mapping", "table", "salted"])
def test_alias_lookup(spark, form):
    aliases = {"mcp": "mcp.json", "settings": "settings.json"}
    df = spark.createDataFrame([(1, "mcp"), (2, "invalid"), (3, None), (4, "mcp")], "id int, short string")
    table = aliases if form == "mapping" else spark.createDataFrame(
        list(aliases.items()), "short string, canonical string"
    )
    ok, rejected = alias_lookup(df, table, "short", salts=3 if form == "salted" else 1)
    assert rows(ok) == [(1, "mcp", "mcp.json"), (4, "mcp", "mcp.json")]
    assert rows(rejected) == sorted([(2, "invalid"), (3, None)], key=repr)
    assert rejected.columns == ["id", "short"]
    if form == "table":
        with pytest.raises(PySparkException, match="aliases"):
            alias_lookup(df, table.union(table), "short")[0].collect()
    if form == "mapping":
        assert alias_lookup(df, {}, "short")[0].isEmpty()


@pytest.mark.parametrize("salts", [1, 3])
def test_inventory(spark, salts):
    items = spark.createDataFrame(
        [
            ("p", "skills", "/r/p/skills/b", "s2"),
            ("p", "skills", "/r/p/skills/A", "s1"),
            ("p", "hooks", None, None),
            ("q", None, "/elsewhere/x", "s3"),
        ],
        "profile string, item string, path string, content string",
    ).withColumn("root", F.concat(F.lit("/r/"), "profile"))
    counts = inventory_counts(items, ["profile", "item"])
    assert rows(counts) == sorted(
        [
            ("p", "skills", 2, "/r/p/skills/A", "/r/p/skills/b"),
            ("p", "hooks", 0, None, None),
            ("q", None, 1, "/elsewhere/x", "/elsewhere/x"),
        ],
        key=repr,
    )
    got = inventory(items, ["profile", "item"], prefix="root", salts=salts, ordered=True)
    assert [tuple(r) for r in got.collect()] == [
        ("p", "hooks", 0, None),
        ("p", "skills", 2, "skills/A"),
        ("p", "skills", 2, "skills/b"),
        ("q", None, 1, "/elsewhere/x"),
    ]
    assert inventory(items, "profile", content="content").columns[-1] == "content"


@pytest.fixture
def small_limits(spark):
    """Settings under which small tables behave like large ones."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def many(spark):
    """60,000 rows, a third of them with the key 0."""
    return spark.range(0, 60_000, numPartitions=8).selectExpr(
        "IF(id % 3 = 0, 0, id) AS k", "uuid() AS payload", "id"
    )


@pytest.fixture
def table(spark):
    # repartitioned, because a plain range counts as partitioned by its id
    rows = spark.range(0, 30_000).repartition(4)
    return rows.selectExpr("id AS k", "CAST(id AS STRING) AS v")


def run_and_explain(df):
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_hot_key_is_split_at_run_time(small_limits, many, table, how):
    n, plan = run_and_explain(lookup_join(many, table, "k", how))
    assert n == {"left": 60_000, "left_anti": 20_000}.get(how, 40_000)
    assert "skew=true" in plan


@pytest.mark.parametrize("form", ["tag", "found", "missing", "alias", "active", "listing", "remove"])
def test_operators_split_hot_keys(spark, small_limits, many, table, form):
    log = table.selectExpr("k", "v", "k AS ts")
    build = {
        "tag": lambda: tag_known(many, table, "k"),
        "found": lambda: exists_guard(many, table.union(table), "k")[0],
        "missing": lambda: exists_guard(many, table, "k")[1],
        "alias": lambda: alias_lookup(many, table, "k", "v")[0],
        "active": lambda: mark_active(
            many, active_state(log, "k", "v", "ts"), "k", "payload", "v"
        ),
        "remove": lambda: managed_remove(many, table.union(table), "k", F.lit(True)),
        "listing": lambda: inventory(many, "k", path="payload"),
    }[form]
    expected = {"found": 40_000, "alias": 40_000, "missing": 20_000, "remove": 20_000}.get(form, 60_000)
    n, plan = run_and_explain(build())
    assert n == expected and "skew=true" in plan


@pytest.mark.parametrize("kind", ["int", "long", "decimal(12,2)", "double"])
@pytest.mark.parametrize("salts", [1, 3])
def test_keys_of_different_types_meet(spark, kind, salts):
    left = spark.range(6).selectExpr(f"CAST(id AS {kind}) AS k", "id")
    right = spark.range(3, 9).selectExpr("CAST(id AS int) AS k", "'x' AS v")
    assert lookup_join(left, right, "k", "inner", salts=salts).count() == 3
    assert exists_guard(left, right, "k", salts=salts)[1].count() == 3
    assert managed_remove(left, right, "k", F.lit(True)).count() == 3


def test_salts_spread_a_hot_key(small_limits, many, table):
    salted = lookup_join(many, table, "k", "left", salts=8, salt_by="id")
    assert salted.count() == 60_000
    used = salted.where("k = 0").select(F.spark_partition_id().alias("p")).distinct()
    assert used.count() > 1


@pytest.mark.parametrize("form", ["mapping", "table"])
def test_strict_aliases(spark, form):
    aliases = {"a": "one", "b": "two"}
    if form == "table":
        aliases = spark.createDataFrame(list(aliases.items()), "alias string, canonical string")
    known = spark.createDataFrame([("a",), ("b",)], "alias string")
    found, unknown = alias_lookup(known, aliases, "alias", strict=True)
    assert found.count() == 2 and unknown.isEmpty()
    for odd in ("c", None):
        more = known.union(spark.createDataFrame([(odd,)], "alias string"))
        with pytest.raises(PySparkException, match="alias not found"):
            alias_lookup(more, aliases, "alias", strict=True)[0].collect()


def shuffled_scans(df, name):
    """Scans of a table that lie below a shuffle."""
    above, found = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [(d, x) for d, x in above if d < depth]
        if name in line and "Scan" in line:
            found += any("Exchange hashpartitioning" in x for _, x in above)
        above.append((depth, line))
    return found


def test_laid_out_tables_are_not_shuffled(spark, monkeypatch):
    from layerframe import save_new_table
    from layerframe.operators import lookup

    monkeypatch.setattr(lookup, "LEAST_HOT", 1_000)
    many = spark.range(12_000).selectExpr("if(id % 3 = 0, 7, id % 500) AS k", "id AS v")
    many = many.union(spark.createDataFrame([(None, -1)], "k long, v long"))
    table = spark.range(0, 500, 2).selectExpr("id AS k", "concat('name ', id) AS canonical").union(
        spark.createDataFrame([(7, "hot")], "k long, canonical string")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        save_new_table(many, "laid_names", "k", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        laid = spark.table("laid_names")
        for make in (
            lambda df, **o: tag_known(df, table, "k", **o),
            lambda df, **o: exists_guard(df, table, "k", **o)[0],
            lambda df, **o: exists_guard(df, table, "k", **o)[1],
            lambda df, **o: alias_lookup(df, table, "k", **o)[0],
            lambda df, **o: alias_lookup(df, table, "k", **o)[1],
            lambda df, **o: mark_active(df.withColumn("n", F.lit("hot")), table, "k", "n", "canonical", **o),
        ):
            got, plain = make(laid, laid_out=True), make(many)
            assert rows(got) == rows(plain)
            assert shuffled_scans(got, "laid_names") == 0 < shuffled_scans(make(laid), "laid_names")
        # Without a hot key there is one join.
        monkeypatch.setattr(lookup, "LEAST_HOT", 1_000_000)
        assert rows(tag_known(laid, table, "k", laid_out=True)) == rows(tag_known(many, table, "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS laid_names")
