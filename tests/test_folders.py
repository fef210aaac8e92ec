"""Folder links at any depth, against what the file system itself says."""

import os
import random

import pytest
from pyspark.sql import functions as F

from layerframe import capture, dereference
from layerframe.operators.folders import linked_files, resolve_links, resolve_paths
from layerframe.operators.keys import FEW_ROWS, join_to_counted


def tree(spark, files, links):
    content = spark.createDataFrame([(f, f"in {f}") for f in files], "path string, content string")
    return content, spark.createDataFrame(links, "src string, dst string")


def made(root, files, links):
    for name in files:
        os.makedirs(os.path.dirname(f"{root}{name}"), exist_ok=True)
        with open(f"{root}{name}", "w") as f:
            f.write(f"in {name}")
    for src, dst in links:
        os.makedirs(os.path.dirname(f"{root}{src}"), exist_ok=True)
        os.symlink(f"{root}{dst}", f"{root}{src}")


def walked(path, inside="", above=()):
    """(inside, text) of the files below a path, folders that hold themselves once."""
    if os.path.isfile(path):
        with open(path) as f:
            yield inside, f.read()
    elif os.path.isdir(path) and (real := os.path.realpath(path)) not in above:
        for name in os.listdir(path):
            yield from walked(f"{path}/{name}", f"{inside}/{name}".strip("/"), (*above, real))


def random_tree(seed):
    rng = random.Random(seed)
    folders = [""]
    for _ in range(8):
        folders.append(f"{rng.choice(folders)}/d{len(folders)}")
    files = sorted({f"{rng.choice(folders)}/f{rng.randrange(9)}" for _ in range(12)})
    made_of = sorted({f[: i] for f in files for i, c in enumerate(f) if c == "/" and i})
    places = [*made_of, ""]
    links = {}
    for i in range(9):
        src = f"{rng.choice(places)}/l{i}"
        way = [*made_of, *files, "/gone", *links, f"/l{rng.randrange(9)}"]
        dst = rng.choice(way)
        if dst in links and rng.random() < 0.5:  # through a link, to what may be below
            dst += f"/{rng.choice(['f1', 'l2', 'd3', 'l7/f2'])}"
        links[src] = dst
    return files, sorted(links.items()), made_of


@pytest.mark.parametrize("seed", range(4))
def test_random_trees_against_the_file_system(spark, tmp_path, seed):
    files, links, folders = random_tree(seed)
    made(tmp_path, files, links)
    content, table = tree(spark, files, links)
    asked = [*folders, *files, *(s for s, _ in links), *(f"{s}/f1" for s, _ in links), "/nothing"]
    targets = spark.createDataFrame([("p", t, t) for t in asked], "scope string, item string, path string")
    got = capture(targets, table, content, entity="scope", item="item").collect()
    expected = [(t, inside, text) for t in asked for inside, text in walked(f"{tmp_path}{t}")]
    assert sorted((r["item"], r["inside"], r["content"]) for r in got) == sorted(expected)
    assert len(expected) > 20


def test_links_three_folders_deep(spark):
    files = ["/a/f0", "/b/f1", "/c/f2", "/d/f3"]
    links = [("/a/l1", "/b"), ("/b/l2", "/c"), ("/c/l3", "/d"), ("/d/back", "/a")]
    content, table = tree(spark, files, links)
    folders = spark.createDataFrame([("/a",)], "folder string")
    ends = resolve_links(table, dereference(table))
    got = {(r["inside"], r["path"], r["status"]) for r in linked_files(folders, ends, content).collect()}
    assert got == {
        ("f0", "/a/f0", "file"),
        ("l1/f1", "/b/f1", "file"),
        ("l1/l2/f2", "/c/f2", "file"),
        ("l1/l2/l3/f3", "/d/f3", "file"),
        ("l1/l2/l3/back", "/a", "cycle"),
    }


def test_a_folder_above_the_one_come_from(spark):
    content, table = tree(spark, ["/p/q/f", "/p/g"], [("/p/q/up", "/p"), ("/p/self", "/p/q/up/q")])
    folders = spark.createDataFrame([("/p/q",), ("/p",)], "folder string")
    ends = resolve_links(table, dereference(table))
    got = {tuple(r)[:2] for r in linked_files(folders, ends, content).where("status = 'file'").collect()}
    assert got == {("/p/q", "f"), ("/p/q", "up/g"), ("/p", "g"), ("/p", "q/f"), ("/p", "self/f")}


def test_links_on_the_way(spark):
    links = [
        ("/l", "/real"), ("/m", "/l/sub"), ("/n", "/m/x/y"), ("/real/sub/x", "/far"),
        ("/own", "/own/below"), ("/x", "/y/1"), ("/y", "/x/2"), ("/to-loop", "/x/z"), ("/away", "/none/here"),
    ]
    table = spark.createDataFrame(links, "src string, dst string")
    ends = resolve_links(table, dereference(table))
    got = {r["src"]: (r["target"], r["hops"], r["status"]) for r in ends.collect()}
    assert got["/m"] == ("/real/sub", 2, "resolved") and got["/n"] == ("/far/y", 4, "resolved")
    assert got["/away"] == ("/none/here", 1, "resolved")
    assert {s for s, r in got.items() if r == (None, None, "loop")} == {"/own", "/x", "/y", "/to-loop"}
    paths = spark.createDataFrame([("/m/x",), ("/own/a/b",), ("/plain",), ("/m/x",), (None,)], "path string")
    there = {r["path"]: tuple(r)[1:] for r in resolve_paths(paths, table, ends).collect()}
    assert there == {"/m/x": ("/far", 3, "resolved"), "/own/a/b": (None, None, "loop"), "/plain": ("/plain", 0, "resolved")}
    near = {r["path"]: r["status"] for r in resolve_paths(paths, table, ends, max_hops=2).collect()}
    assert near == {"/m/x": "too_long", "/own/a/b": "loop", "/plain": "resolved"}


def test_no_links_and_empty_tables(spark):
    content, table = tree(spark, ["/a/b"], [("/z", "/a")])
    targets = spark.createDataFrame([("p", "i", "/a")], "scope string, item string, path string")
    args = {"entity": "scope", "item": "item"}
    got = capture(targets, table.limit(0), content, **args).collect()
    assert [(r["inside"], r["hops"]) for r in got] == [("b", 0)]
    assert capture(targets.limit(0), table, content, **args).isEmpty()
    assert capture(targets, table, content.limit(0), **args).isEmpty()
    filled = capture(targets, table, content.limit(0), **args, items=["i"], defaults={"content": F.lit("")})
    assert [r["filled"] for r in filled.collect()] == [True]


def test_no_table_of_names_is_broadcast(spark):
    content, table = tree(spark, ["/a/f", "/b/g"], [("/a/l", "/b"), ("/x", "/a")])
    targets = spark.createDataFrame([("p", "i", "/x"), ("p", "j", "/a/f")], "scope string, item string, path string")
    args = {"entity": "scope", "item": "item", "items": ["i", "j", "k"], "defaults": {"content": ""}}
    taken = capture(targets, table, content, **args)
    assert taken.count() == 4
    ends = resolve_links(table, dereference(table))
    below = linked_files(spark.createDataFrame([("/a",)], "folder string"), ends, content)
    assert below.count() == 2
    for made in (taken, below):  # the files are small, but how small says little of the rows
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_few_counted_rows_are_broadcast(spark):
    rows = spark.range(9).withColumnRenamed("id", "k")
    for n, way in ((FEW_ROWS, "BroadcastHashJoin"), (FEW_ROWS + 1, "SortMergeJoin")):
        joined = join_to_counted(rows, rows.where("k > 5"), n, "k")
        assert way in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 3
