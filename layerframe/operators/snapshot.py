"""Links followed to their ends, and snapshots detached from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.operators.folders import linked_files, resolve_links, resolve_paths
from layerframe.operators.keys import (
    Keys,
    join_to_counted,
    key_list,
    merge_join,
    require_unique,
    require_unique_counted,
)
from layerframe.operators.lookup import lookup_join
from layerframe.operators.overlay import fill_defaults
from layerframe.sources.shared import new_shared_path, written_table


def dereference(
    links: DataFrame,
    src: str = "src",
    dst: str = "dst",
    max_hops: int | None = None,
    check: bool = True,
) -> DataFrame:
    """Where each link ends: (``src``, ``target``, ``hops``, ``status``).

    ``status`` is ``resolved``, or ``loop`` for a link that leads into a cycle,
    which has no target. With ``max_hops`` links that end further away have no
    target either and are ``too_long``; by default chains may have any length.
    Whether anything exists at the target is for the caller to look up. A name
    with two links is an error, a link without a name is ignored.

    Each round lets every open link jump to where its own target points, which
    doubles the distance: rounds grow with the logarithm of the longest chain,
    and usual tables of direct links need none. As long as a chain with an end
    is open, its next link to close does so in the next round; a round that closes
    nothing leaves only cycles. A round writes only the links it moved. Rounds go
    through written tables, so the plan stays short and a lost executor costs
    no earlier round.
    """
    edges = links.select(F.col(src).alias("src"), F.col(dst).alias("target"))
    edges = edges.where(F.col("src").isNotNull())
    sources = edges.select(F.col("src").alias("target"), F.lit(True).alias("__more"))
    if check:
        # Checked on this side only: it sees every link and is shuffled on the
        # name in any case.
        sources = require_unique(sources, "target", "links")
    first = lookup_join(edges, sources, "target", large=True).select(
        "src",
        "target",
        F.lit(1).cast("long").alias("hops"),
        F.coalesce("__more", F.lit(False)).alias("open"),
    )
    root = new_shared_path(links.sparkSession, "links")
    latest = written_table(first, f"{root}/0")
    state, closed = latest, latest.where("NOT open")
    rounds = 0
    while n := latest.where("open").count():
        rounds += 1
        latest = written_table(_jump(latest, state, n), f"{root}/{rounds}")
        state = closed.unionByName(latest)
        just_closed = latest.where("NOT open")
        if just_closed.isEmpty():
            break
        closed = closed.unionByName(just_closed)
    status = F.when(F.col("open"), "loop")
    if max_hops is not None:
        status = status.when(F.col("hops") > max_hops, "too_long")
    status = status.otherwise("resolved")
    ended = status == "resolved"
    return state.select(
        F.col("src").alias(src),
        F.when(ended, F.col("target")).alias("target"),
        F.when(ended, F.col("hops")).alias("hops"),
        status.alias("status"),
    )


def _jump(latest: DataFrame, state: DataFrame, n: int) -> DataFrame:
    onward = state.select(
        F.col("src").alias("target"),
        F.col("target").alias("__target"),
        F.col("hops").alias("__hops"),
        F.col("open").alias("__open"),
    )
    return join_to_counted(onward, latest.where("open"), n, "target").select(
        "src",
        F.col("__target").alias("target"),
        (F.col("hops") + F.col("__hops")).alias("hops"),
        F.col("__open").alias("open"),
    )


def capture(
    targets: DataFrame,
    links: DataFrame,
    content: DataFrame,
    *,
    entity: Keys,
    item: str,
    path: str = "path",
    entities: DataFrame | None = None,
    items: Sequence[Any] | DataFrame = (),
    defaults: Mapping[str, Any] | None = None,
    max_hops: int | None = None,
) -> DataFrame:
    """Snapshot of ``targets`` holding contents instead of links.

    ``targets`` has (entity, item, path), ``links`` (src, dst) and ``content``
    the path with its other columns, one row per file. Links are followed, on the
    way to a target too. A target may be a file or a folder: of a folder every
    file below it is a row, links in there and in the folders that they lead to
    followed at any depth, and ``inside`` is the path below the target (empty
    for a file). A link back to a folder that was entered on the way is not
    followed again; :func:`linked_files` lists those. Targets that are absent,
    dangling or in a loop and folders without files are left out, and with
    ``items`` the gaps are filled from ``defaults`` for all ``entities`` (by
    default those with a target). ``hops`` counts the links on the way to the
    target, not those inside it, and is NULL for a filled row. Repeated targets
    and content paths are errors.
    """
    entity = key_list(entity)
    given_paths = targets.select(F.col(path).cast("string").alias("path"))
    targets = require_unique_counted(targets, [*entity, item], "targets")
    content = require_unique_counted(content, path, "content")
    ends = resolve_links(links, dereference(links), max_hops)
    asked = targets.select(*entity, item, F.col(path).cast("string").alias("__path"))
    led = resolve_paths(given_paths, links, ends, max_hops)
    led = led.where("status = 'resolved'").select(
        F.col("path").alias("__path"), F.col("target").alias("folder"), "hops"
    )
    root = new_shared_path(targets.sparkSession, "capture")
    here = written_table(lookup_join(asked, led, "__path", "inner", large=True).drop("__path"), f"{root}/ends")
    places = linked_files(here.select("folder").distinct(), ends, content, path)
    places = places.where("status = 'file'").select("folder", "inside", F.col("path").alias(path))
    # The contents are wide and joined only once, for the result; what is
    # absent is worked out from the narrow rows written here.
    here = written_table(merge_join(here, places, "folder").drop("folder"), f"{root}/files")
    copied = lookup_join(here, content, path, "inner", large=True).drop(path)
    given = entities is not None
    if not given:
        entities = targets.select(*entity).distinct()
    return fill_defaults(
        copied,
        entities,
        items,
        entity=entity,
        item=item,
        defaults=defaults or {},
        held=here,
        check=given,
    )
