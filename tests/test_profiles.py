"""The whole life of a profile, many at once."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from layerframe.plans import fixed_values as fixed
from layerframe.plans import profiles as p

TARGETS = "scope string, target string, value string, owner string"
LOG = "scope string, profile string, ts int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(
        [("test", "test-id"), ("second", None)], "profile string, gateway_id string"
    )


def test_create(spark, registry):
    names = spark.createDataFrame(
        [("test", "x"), ("manual", None), ("gated", 'id"1')], "profile string, gateway_id string"
    )
    created, taken = p.create_profiles(names, registry)
    assert rows(taken) == [("test",)]
    got = {(r.profile, r.item): (r.path, r.content) for r in created.collect()}
    assert len(got) == 18 and {k[0] for k in got} == {"manual", "gated"}
    for name in ["manual", "gated"]:
        assert [i for i in p.ITEMS if (name, i) in got] == p.ITEMS
        assert got[name, "settings.json"] == ("settings.json", fixed.BLANK_SETTINGS)
        assert got[name, "settings.local.json"][1] == fixed.BLANK_JSON
        assert got[name, "CLAUDE.md"] == ("CLAUDE.md", "")
        assert got[name, "hooks"] == (None, None)
    assert got["manual", "mcp.json"][1] == fixed.BLANK_SERVERS
    gateway = json.loads(got["gated", "mcp.json"][1])
    assert gateway["mcpServers"]["MCP_DOCKER"]["args"][-1] == 'id"1'
    for text in [fixed.BLANK_SERVERS, fixed.BLANK_SETTINGS, fixed.BLANK_JSON]:
        assert isinstance(json.loads(text), dict)


def test_complete_items_keeps_what_is_there(spark, registry):
    items = spark.createDataFrame(
        [("test", "skills", "skills/a/SKILL.md", "mine"), ("test", "CLAUDE.md", "CLAUDE.md", "")],
        "profile string, item string, path string, content string",
    )
    got = p.complete_items(items, registry)
    assert got.where("NOT filled").count() == 2
    assert got.where("filled AND profile = 'test'").count() == 7
    assert got.where("filled AND profile = 'second'").count() == 9


def test_servers_with_extras(spark, registry):
    extra = '{"mcpServers": {"remote": {"type": "http", "url": "http://example.com:1/mcp"}}}'
    extras = spark.createDataFrame(
        [("test", extra), ("second", extra)], "profile string, content string"
    )
    (got,) = p.server_docs(registry, extras).collect()
    servers = json.loads(got.content)["mcpServers"]
    assert (got.profile, got.status) == ("test", "merged")
    assert servers["MCP_DOCKER"]["args"] == [*fixed.GATEWAY_ARGS, "test-id"]
    assert servers["remote"]["url"] == "http://example.com:1/mcp"
    broken = extras.withColumn("content", F.lit("{"))
    (got,) = p.server_docs(registry, broken).collect()
    assert got.status == "invalid" and list(json.loads(got.content)["mcpServers"]) == ["MCP_DOCKER"]
    items = p.complete_items(
        spark.createDataFrame([], "profile string, item string, path string, content string"),
        registry,
    ).drop("filled")
    synced = p.sync_servers(items, registry, extras)
    assert synced.count() == 18
    (doc,) = synced.where("profile = 'test' AND item = 'mcp.json'").collect()
    assert "remote" in doc.content
    (doc,) = synced.where("profile = 'second' AND item = 'mcp.json'").collect()
    assert doc.content == fixed.BLANK_SERVERS


def test_activate_switch_and_deactivate(spark, registry):
    empty = spark.createDataFrame([], TARGETS)
    use = spark.createDataFrame([("w", "test"), ("v", "second")], "scope string, profile string")
    first = p.activate(empty, use, registry)
    assert first.count() == 18 and {r.outcome for r in first.collect()} == {"inserted"}
    (link,) = first.where("scope = 'w' AND target = '.mcp.json'").collect()
    assert (link.value, link.owner) == ("test/mcp.json", "test")

    switch = use.where("scope = 'w'").withColumn("profile", F.lit("second"))
    second = p.activate(first.drop("outcome"), switch, registry)
    owners = {(r.scope, r.owner) for r in second.collect()}
    assert owners == {("w", "second"), ("v", "second")} and second.count() == 18

    log = spark.createDataFrame([("w", "test", 1), ("w", "second", 2), ("v", None, 3)], LOG)
    scopes = spark.createDataFrame([("w",), ("v",), ("u",)], "scope string")
    left = p.deactivate(second.drop("outcome"), scopes, log, "ts")
    assert {r.scope for r in left.collect()} == {"v"}  # not active, so not cleared

    unknown = use.withColumn("profile", F.lit("unheard-of"))
    with pytest.raises(PySparkException, match="not found: unheard-of"):
        p.activate(empty, unknown, registry).collect()


def test_activate_leaves_foreign_targets(spark, registry):
    held = spark.createDataFrame(
        [
            ("w", ".mcp.json", "real", None),
            ("w", ".claude/settings.json", "real", None),
            ("w", "README", "real", None),
        ],
        TARGETS,
    )
    use = spark.createDataFrame([("w", "test")], "scope string, profile string")
    got = {r.target: r for r in p.activate(held, use, registry).collect()}
    assert len(got) == 10
    assert got[".mcp.json"].outcome == got[".claude/settings.json"].outcome == "conflict"
    assert got[".mcp.json"].value == "real" and got[".mcp.json"].owner is None
    assert got["README"].outcome == "kept" and got["CLAUDE.md"].outcome == "inserted"
    assert rows(p.activate(held, use, registry, small_requests=True)) == rows(
        p.activate(held, use, registry)
    )
    after = p.activate(held, use, registry).drop("outcome")
    log = spark.createDataFrame([("w", "test", 1)], LOG)
    scopes = spark.createDataFrame([("w",)], "scope string")
    assert rows(p.deactivate(after, scopes, log, "ts")) == rows(held)


def test_list_and_current(spark):
    log = spark.createDataFrame([("w", "test", 1), ("v", "test", 1), ("v", None, 2)], LOG)
    names = spark.createDataFrame(
        [(s, n) for s in "wv" for n in ("test", "second")], "scope string, profile string"
    )
    assert rows(p.current_profiles(log, "ts")) == [("w", "test")]
    got = p.list_profiles(names, log, "ts")
    assert [r[:2] for r in rows(got) if r[2]] == [("w", "test")]


def test_show(spark, registry):
    items = spark.createDataFrame(
        [
            ("test", "skills", "skills/a", ""),
            ("test", "skills", "skills/b", ""),
            ("second", "hooks", None, None),
            ("second", "mcp.extra.json", "mcp.extra.json", "{}"),
        ],
        "profile string, item string, path string, content string",
    )
    assert rows(p.show_profiles(items, registry)) == [
        ("second", "hooks", ".claude/hooks", "manual", 0),
        ("test", "skills", ".claude/skills", "gateway", 2),
    ]


def test_capture(spark):
    targets = spark.createDataFrame(
        [("c", "mcp.json", "/w/.mcp.json"), ("c", "CLAUDE.md", "/w/CLAUDE.md")],
        "profile string, item string, path string",
    )
    links = spark.createDataFrame([("/w/.mcp.json", "/profiles/test/mcp.json")], "src string, dst string")
    content = spark.createDataFrame(
        [("/profiles/test/mcp.json", "{}"), ("/w/CLAUDE.md", "# mine")],
        "path string, content string",
    )
    got = {r.item: r for r in p.capture_profiles(targets, links, content).collect()}
    assert len(got) == 9
    assert got["mcp.json"].content == "{}" and got["mcp.json"].hops == 1
    assert got["CLAUDE.md"].content == "# mine"
    assert got["settings.json"].filled and got["settings.json"].content == fixed.BLANK_SETTINGS


def test_components_and_refs(spark):
    names = [*fixed.COMPONENT_ITEMS, "no-such-part"]
    df = spark.createDataFrame([(n,) for n in names], "component string")
    ok, rejected = p.component_items(df)
    assert dict(rows(ok)) == fixed.COMPONENT_ITEMS
    assert set(fixed.COMPONENT_ITEMS.values()) == set(fixed.ITEM_TARGETS)
    assert rows(rejected) == [("no-such-part",)]
    refs = spark.createDataFrame([("registry.example/tools/indexer:v2",)], "ref string")
    assert rows(p.server_refs(refs)) == [("docker://registry.example/tools/indexer:v2",)]


def test_names_are_required_and_exclusive(spark, registry):
    for bad in ("", None):
        names = spark.createDataFrame([(bad, "x"), ("fine", "y")], "profile string, gateway_id string")
        # Several stages may meet the row; then Spark names their number only.
        with pytest.raises(Exception, match="name is required|MULTIPLE_FAILURES"):
            p.create_profiles(names, registry)[0].collect()
    targets = spark.createDataFrame(
        [("second", "mcp.json", "/a"), ("fresh", "mcp.json", "/a")], "profile string, item string, path string"
    )
    links = spark.createDataFrame([], "src string, dst string")
    content = spark.createDataFrame([("/a", "A")], "path string, content string")
    with pytest.raises(Exception, match="exists already: second"):
        p.capture_profiles(targets, links, content, registry=registry).collect()
    fresh = targets.where("profile = 'fresh'")
    taken = p.capture_profiles(fresh, links, content, registry=registry)
    assert taken.where("NOT filled").count() == 1 and taken.count() == len(fixed.ITEM_TARGETS)


def test_log_rows_of_a_switch(spark):
    log = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 1), ("s2", None, 2)], LOG)
    added = p.activation_log(spark.createDataFrame([("s2", "b")], "scope string, profile string"))
    assert rows(added) == [("s2", "b")]
    scopes = spark.createDataFrame([("s1",), ("s1",), ("s2",), ("s3",)], "scope string")
    assert rows(p.deactivation_log(scopes, log, "ts")) == [("s1", None)]


def test_show_tells_who_has_extras(spark):
    items = spark.createDataFrame(
        [(n, "skills", "skills/a") for n in ("gw", "gw-plain", "hand")], "profile string, item string, path string"
    )
    registry = spark.createDataFrame([("gw", "1"), ("gw-plain", "2"), ("hand", None)], "profile string, gateway_id string")
    extras = spark.createDataFrame([("gw", "{}"), ("gw", "again"), ("hand", "{}")], "profile string, content string")
    got = p.show_profiles(items, registry, extras).collect()
    assert {r.profile: (r.servers, r.has_extras, r.n_files) for r in got} == {
        "gw": ("gateway", True, 1), "gw-plain": ("gateway", False, 1), "hand": ("manual", False, 1)
    }
    assert "has_extras" not in p.show_profiles(items, registry).columns


def test_deactivate_pairs_scopes_alone(spark):
    held = spark.createDataFrame(
        [
            ("w", ".mcp.json", "a/mcp.json", "a"),
            ("w", "README", "a/README", "a"),
            ("w", "CLAUDE.md", "mine", None),
            ("v", ".mcp.json", "a/mcp.json", "a"),
            (None, ".mcp.json", "a/mcp.json", "a"),
            ("w", None, "a/none", "a"),
        ],
        TARGETS,
    )
    log = spark.createDataFrame([("w", "a", 1), ("v", "a", 1), ("v", None, 2)], LOG)
    scopes = spark.createDataFrame([("w",), ("w",), ("v",), (None,)], "scope string")
    left = p.deactivate(held, scopes, log, "ts")
    assert rows(left) == rows(held.where("NOT (scope <=> 'w' AND target <=> '.mcp.json')"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastHashJoin LeftAnti" not in plan
