"""Paths with links on the way, and what lies below folders that hold links.

Names are texts with ``/`` between their parts. Files and links are to be given
by the places where they are: none lies below the name of a link or of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.operators.keys import join_to_counted, merge_join
from layerframe.operators.lookup import lookup_join
from layerframe.sources.shared import new_shared_path, written_table


def resolve_links(
    links: DataFrame, ends: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """``ends`` of whole names, with links on the way to their targets followed.

    ``links`` has (src, dst) and ``ends`` is what :func:`dereference` makes of
    them. A target may lead through folders that are links in turn. Returned are
    (src, target, hops, status) as before, where ``loop`` now also covers links
    that need themselves on the way.

    A target is rewritten at its shortest beginning that is a link, as soon as
    that link is settled. Links that wait for each other are loops: a round in which
    none can be rewritten leaves only those. There are as many rounds as links
    lie on the way to others, and none if none does.
    """
    names = links.select(F.col("src").alias("__via")).where("__via IS NOT NULL").distinct()
    state = ends.select(
        "src",
        F.col("target").cast("string").alias("path"),
        "hops",
        (F.col("status") != "resolved").alias("lost"),
    )
    settled = _settled(state, names, None, "links")
    return _with_status(settled.withColumn("start", F.lit(0)), max_hops, "src")


def resolve_paths(
    paths: DataFrame, links: DataFrame, ends: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """Where each of ``paths`` (column ``path``) leads: (path, target, hops, status).

    ``ends`` is what :func:`resolve_links` makes of ``links``. A path that meets
    no link is its own target, after 0 hops.
    """
    names = links.select(F.col("src").alias("__via")).where("__via IS NOT NULL").distinct()
    state = paths.select("path").where("path IS NOT NULL").distinct().select(
        F.col("path").alias("src"),
        "path",
        F.lit(0).cast("long").alias("hops"),
        F.lit(False).alias("lost"),
    )
    known = ends.select(
        "src", F.col("target").alias("path"), "hops", (F.col("status") == "loop").alias("lost")
    )
    settled = _settled(state, names, known, "paths")
    return _with_status(settled, max_hops, "path")


def _with_status(settled: DataFrame, max_hops: int | None, name: str) -> DataFrame:
    status = F.when(F.col("lost"), "loop")
    if max_hops is not None:
        status = status.when(F.col("hops") > max_hops, "too_long")
    status = status.otherwise("resolved")
    ended = status == "resolved"
    return settled.select(
        F.col("src").alias(name),
        F.when(ended, F.col("path")).alias("target"),
        F.when(ended, F.col("hops")).alias("hops"),
        status.alias("status"),
    )


def _settled(state: DataFrame, names: DataFrame, known: DataFrame | None, label: str) -> DataFrame:
    """``state`` with its paths rewritten until no link is on their way.

    Rewriting looks links up in ``known``, or in what is settled of ``state`` itself.
    """
    if known is None and _first_links(state, names).isEmpty():
        return state  # as usual: no link lies on the way of another
    root = new_shared_path(state.sparkSession, label)
    latest = written_table(_with_first_link(state, names), f"{root}/0")
    done = latest.where("__via IS NULL").drop("__via")
    waiting = latest.where("__via IS NOT NULL")
    rounds = 0
    while not waiting.isEmpty():
        rounds += 1
        via = (done if known is None else known).select(
            F.col("src").alias("__via"),
            F.col("path").alias("__to"),
            F.col("hops").alias("__hops"),
            F.col("lost").alias("__lost"),
        )
        stepped = merge_join(waiting, via, "__via", "left")
        if known is None:
            stepped = written_table(stepped, f"{root}/{rounds}-stepped")
        moved = stepped.where("__lost IS NOT NULL")
        if known is None and moved.isEmpty():
            break
        onward = moved.select(
            "src",
            F.expr("__to || substring(path, length(__via) + 1)").alias("path"),
            (F.col("hops") + F.col("__hops")).alias("hops"),
            F.col("__lost").alias("lost"),
        )
        latest = _with_first_link(onward, names)
        if known is None:  # otherwise every link is settled, and nothing has to wait
            still = stepped.where("__lost IS NULL").select(latest.columns)
            latest = latest.unionByName(still)
        latest = written_table(latest, f"{root}/{rounds}")
        done = done.unionByName(latest.where("__via IS NULL").drop("__via"))
        waiting = latest.where("__via IS NOT NULL")
    return done.unionByName(waiting.drop("__via").withColumn("lost", F.lit(True)))


def _with_first_link(state: DataFrame, names: DataFrame) -> DataFrame:
    """``state`` with ``__via``, the shortest beginning of ``path`` that is a link."""
    found = _first_links(state, names)
    return lookup_join(state, found, "path", "left", large=True).select(*state.columns, "__via")


def _first_links(state: DataFrame, names: DataFrame) -> DataFrame:
    """(``path``, ``__via``) of the paths of ``state`` that meet a link."""
    paths = state.where("NOT lost AND path IS NOT NULL").select("path").distinct()
    begun = paths.select("path", beginnings(F.col("path")).alias("__via"))
    return lookup_join(begun, names, "__via", "left_semi", large=True).groupBy("path").agg(
        F.min_by("__via", F.length("__via")).alias("__via")
    )


def beginnings(path: Column) -> Column:
    """The folders above a path and the path itself, a row each."""
    parts = F.split(path, "/")
    each = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    return F.explode(each)


def linked_files(
    folders: DataFrame, ends: DataFrame, content: DataFrame, path: str = "path"
) -> DataFrame:
    """Everything below ``folders``, with links in there followed at any depth.

    ``folders`` has the column ``folder``, with each name once and no link on its
    way, ``ends`` is the result of :func:`resolve_links`. A link shows what it
    leads to under its own name, in a folder that it leads to the links are
    followed too. Returned are (folder, inside, path, status): a row with
    ``file`` for each file, where ``inside`` is its name below the folder (empty
    where the folder is itself a file), and one with ``cycle`` for each link that
    leads back to a folder it was reached through, which is not entered again.

    Rounds go by the number of links on the way, each through a written table of
    the folders that were reached; files are joined once, at the end.
    """
    led = ends.where("status = 'resolved'").select(
        F.col("src").alias("__place"), F.col("target").alias("__end")
    )
    above = led.select("*", beginnings(F.col("__place")).alias("node"))
    # A link below a folder, under its name in there.
    edges = above.where("node <> __place")
    root = new_shared_path(folders.sparkSession, "folders")
    way = "array<struct<node:string,place:string>>"
    reached = folders.select(
        "folder",
        F.col("folder").alias("node"),
        F.lit("").alias("shown"),
        F.array().cast(way).alias("way"),
        F.lit("file").alias("status"),
    )
    latest = written_table(reached, f"{root}/0")
    everything, rounds = latest, 0
    while n := latest.count():
        rounds += 1
        entered = written_table(_entered(latest, edges, n), f"{root}/{rounds}")
        everything = everything.unionByName(entered)
        latest = entered.where("status = 'file'")
    files = content.select(F.col(path).alias("__file")).where("__file IS NOT NULL")
    files = files.select("__file", beginnings(F.col("__file")).alias("node"))
    nodes = everything.where("status = 'file'")
    found = merge_join(files, nodes, "node").where(~_beyond(F.col("__file")))
    name = F.expr("substring(__file, length(node) + 2)")
    files = found.select(
        "folder", _below(F.col("shown"), name).alias("inside"), F.col("__file").alias("path"), "status"
    )
    cycles = everything.where("status = 'cycle'")
    return files.unionByName(
        cycles.select("folder", F.col("shown").alias("inside"), F.col("node").alias("path"), "status")
    )


def _entered(latest: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The folders and files to which the links below those of ``latest`` lead."""
    step = F.struct("node", F.col("__place").alias("place"))
    met = join_to_counted(edges, latest, n, "node").where(~_beyond(F.col("__place")))
    met = met.withColumn("way", F.concat("way", F.array(step)))
    end = F.col("__end")

    def goes_back(w: Column) -> Column:
        entered = (w["node"] == end) | end.startswith(F.concat(w["node"], F.lit("/")))
        return entered & w["place"].startswith(F.concat(end, F.lit("/")))

    name = F.expr("substring(__place, length(node) + 2)")
    return met.select(
        "folder",
        end.alias("node"),
        _below(F.col("shown"), name).alias("shown"),
        "way",
        F.when(F.exists("way", goes_back), "cycle").otherwise("file").alias("status"),
    )


def _beyond(place: Column) -> Column:
    """Is ``place`` in a folder below ``node`` through which ``node`` was reached?"""
    below = F.concat(F.col("node"), F.lit("/"))
    return F.exists(
        "way",
        lambda w: w["node"].startswith(below) & place.startswith(F.concat(w["node"], F.lit("/"))),
    )


def _below(shown: Column, name: Column) -> Column:
    return F.concat(shown, F.when((shown != "") & (name != ""), "/").otherwise(""), name)
