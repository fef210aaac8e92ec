"""Profile workflows over whole tables of profiles and working scopes.

A profile is a named bundle of items; a scope (a project, a tenant, a host) has
at most one active profile, whose items are linked under fixed targets. Every
function handles all profiles and scopes in its input tables as one plan.

    registry  (profile, gateway_id)         gateway_id NULL: servers by hand
    items     (profile, item, path, content) path NULL: an empty folder
    targets   (scope, target, value, owner)  owner NULL: not put there by us
    requests  (scope, profile)
    log       (scope, profile, + order columns), profile NULL: deactivated
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.functions.documents import overlay_json, render_doc
from layerframe.functions.refs import normalize_ref
from layerframe.operators.inventory import inventory_counts
from layerframe.operators.keys import Keys, require_known, require_unique
from layerframe.operators.lookup import (
    alias_lookup,
    canonical_name,
    exists_guard,
    lookup_join,
    mark_active,
)
from layerframe.operators.managed import managed_apply, managed_remove
from layerframe.operators.overlay import fill_defaults, overlay_rows
from layerframe.operators.snapshot import capture
from layerframe.operators.state import active_state
from layerframe.plans import fixed_values as fixed

ITEMS = list(fixed.ITEM_TARGETS)


def _owned() -> Column:
    # Columns need a running session, so this cannot be a constant.
    return F.col("owner").isNotNull()


def blank_content(item: Column) -> Column:
    """Content of a newly made item; NULL for a folder."""
    return (
        F.when(item == "mcp.json", fixed.BLANK_SERVERS)
        .when(item == "settings.json", fixed.BLANK_SETTINGS)
        .when(item.endswith(".json"), fixed.BLANK_JSON)
        .when(item.endswith(".md"), fixed.BLANK_TEXT)
    )


def blank_path(item: Column) -> Column:
    return F.when(item.endswith(".json") | item.endswith(".md"), item)


def gateway_doc(gateway_id: Column) -> Column:
    """Server document that starts the gateway for ``gateway_id``."""
    args = F.array(*[F.lit(a) for a in fixed.GATEWAY_ARGS], gateway_id)
    entry = F.struct(F.lit(fixed.GATEWAY_COMMAND).alias("command"), args.alias("args"))
    return render_doc(
        F.struct(entry.alias(fixed.GATEWAY_NAME)).alias(fixed.SERVERS_FIELD)
    )


def complete_items(items: DataFrame, registry: DataFrame) -> DataFrame:
    """``items`` with blanks for what a registered profile lacks."""
    return fill_defaults(
        items,
        registry,
        ITEMS,
        entity="profile",
        item="item",
        defaults={
            "path": blank_path(F.col("item")),
            "content": blank_content(F.col("item")),
        },
    )


def create_profiles(
    names: DataFrame, registry: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Items of the profiles in ``names`` that are new, and the names taken.

    ``names`` is like ``registry``; a profile with a gateway gets the gateway
    document in place of a blank list of servers. A name is required: one that is
    NULL or empty fails the job.
    """
    named = F.coalesce(F.col("profile") != "", F.lit(False))
    missing = F.raise_error(F.lit("profile: a name is required")).cast("boolean")
    names = names.where(F.when(named, True).otherwise(missing))
    taken, new = exists_guard(names, registry, "profile")
    item = F.col("item")
    with_gateway = (item == "mcp.json") & F.col("gateway_id").isNotNull()
    nothing = new.select(
        "profile",
        F.lit("").alias("item"),
        F.lit("").alias("path"),
        F.lit("").alias("content"),
    ).limit(0)
    created = fill_defaults(
        nothing,
        new,
        ITEMS,
        entity="profile",
        item="item",
        defaults={
            "path": blank_path(item),
            "content": F.when(with_gateway, gateway_doc(F.col("gateway_id"))).otherwise(
                blank_content(item)
            ),
        },
    )
    return created.drop("filled"), taken.select("profile")


def server_docs(registry: DataFrame, extras: DataFrame) -> DataFrame:
    """(profile, content, status) for the profiles that have a gateway.

    ``extras`` (profile, content) holds server documents kept by hand; their
    entries win over the gateway's. A broken one leaves the gateway alone and
    shows as ``invalid``.
    """
    own = extras.select("profile", F.col("content").alias("__extra"))
    with_extras = registry.where("gateway_id IS NOT NULL").join(
        require_unique(own, "profile", "extras"), "profile", "left"
    )
    return overlay_json(
        with_extras,
        gateway_doc(F.col("gateway_id")),
        F.col("__extra"),
        fixed.SERVERS_FIELD,
        doc="content",
    ).select("profile", "content", "status")


def sync_servers(items: DataFrame, registry: DataFrame, extras: DataFrame) -> DataFrame:
    """``items`` with the generated server documents written over the old ones.

    Only the rows that hold server documents are joined; the rest, with all the
    large contents, is passed on as it is.
    """
    docs = server_docs(registry, extras).select(
        "profile",
        F.lit("mcp.json").alias("item"),
        F.lit("mcp.json").alias("path"),
        "content",
    )
    is_servers = F.col("item").eqNullSafe("mcp.json")
    servers = overlay_rows(
        items.where(is_servers), docs, ["profile", "item", "path"], check=False
    )
    return items.where(~is_servers).unionByName(servers.drop("origin"))


def requested_targets(requests: DataFrame) -> DataFrame:
    """The target rows that activating ``requests`` wants to have."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("item"), F.lit(t).alias("target"))
                for i, t in fixed.ITEM_TARGETS.items()
            ]
        )
    )
    return requests.select("scope", "profile", pairs.alias("pair")).select(
        "scope",
        F.col("pair.target").alias("target"),
        F.concat_ws("/", "profile", "pair.item").alias("value"),
        F.col("profile").alias("owner"),
    )


def activate(
    targets: DataFrame,
    requests: DataFrame,
    registry: DataFrame,
    small_requests: bool = False,
) -> DataFrame:
    """Targets after switching every requested scope, with an ``outcome`` each.

    An unknown profile fails the job. What the old profile had linked in such
    a scope is replaced; targets that belong to no profile stay and show as
    ``conflict``. With ``small_requests`` a large table of targets need not be
    shuffled to switch a few scopes.
    """
    known = require_known(requests, registry, "profile", "profile")
    # Every request wants all targets of the map, so writing them over replaces
    # just what clearing the scope first would have removed.
    incoming = requested_targets(known)
    return managed_apply(
        targets,
        incoming,
        ["scope", "target"],
        _owned(),
        small_incoming=small_requests,
    )


def deactivate(targets: DataFrame, scopes: DataFrame, log: DataFrame, order: Keys) -> DataFrame:
    """Targets after clearing the given scopes, as far as they are active."""
    active = scopes.select("scope").join(
        current_profiles(log, order).select("scope"), "scope", "left_semi"
    )
    # Scopes alone, for with each target of the map they would be many times as many.
    known = F.col("target").isin(list(fixed.ITEM_TARGETS.values()))
    return managed_remove(targets, active, "scope", _owned() & known)


def activation_log(requests: DataFrame) -> DataFrame:
    """The rows (scope, profile) that activating ``requests`` adds to the log."""
    return requests.select("scope", "profile")


def deactivation_log(scopes: DataFrame, log: DataFrame, order: Keys) -> DataFrame:
    """The rows that clearing ``scopes`` adds to the log: NULL where one was active."""
    active = current_profiles(log, order)
    cleared = scopes.select("scope").join(active.select("scope"), "scope", "left_semi")
    return cleared.distinct().withColumn("profile", F.lit(None).cast(active.schema["profile"].dataType))


def current_profiles(log: DataFrame, order: Keys) -> DataFrame:
    """(scope, profile) of the scopes that have an active profile."""
    return active_state(log, "scope", "profile", order)


def list_profiles(names: DataFrame, log: DataFrame, order: Keys) -> DataFrame:
    """``names`` (scope, profile) with ``is_active``."""
    state = current_profiles(log, order)
    return mark_active(names, state, "scope", "profile", "profile", check=False)


def show_profiles(
    items: DataFrame, registry: DataFrame, extras: DataFrame | None = None
) -> DataFrame:
    """Per profile and item: target, number of files and how servers are kept.

    With ``extras`` (rows by profile) ``has_extras`` tells whether servers kept by
    hand are added to those of the gateway; profiles without a gateway have none.
    """
    counts = inventory_counts(
        items.where(F.col("item").isin(ITEMS)), ["profile", "item"]
    )
    mode = registry.select(
        "profile",
        F.when(F.col("gateway_id").isNull(), "manual").otherwise("gateway").alias("servers"),
    )
    flags = ["servers"]
    if extras is not None:
        known = extras.select("profile").distinct().withColumn("__extra", F.lit(True))
        has_extras = (F.col("servers") == "gateway") & F.coalesce("__extra", F.lit(False))
        mode = mode.join(known, "profile", "left").withColumn("has_extras", has_extras).drop("__extra")
        flags.append("has_extras")
    return lookup_join(counts, mode, "profile").select(
        "profile",
        "item",
        canonical_name(F.col("item"), fixed.ITEM_TARGETS).alias("target"),
        *flags,
        "n_files",
    )


def capture_profiles(
    targets: DataFrame,
    links: DataFrame,
    content: DataFrame,
    scopes: DataFrame | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Snapshot of (profile, item, path) targets with blanks for the gaps.

    With a ``registry`` of profiles that exist, a snapshot under a name in it
    fails the job: names are exclusive.
    """
    if registry is not None:
        targets = _require_free(targets, registry)
        scopes = None if scopes is None else _require_free(scopes, registry)
    return capture(
        targets,
        links,
        content,
        entity="profile",
        item="item",
        entities=scopes,
        items=ITEMS,
        defaults={"content": blank_content(F.col("item"))},
    )


def _require_free(named: DataFrame, registry: DataFrame) -> DataFrame:
    # Names are grouped, so a name with very many rows is combined beforehand.
    sides = named.select("profile", F.lit(False).alias("taken")).unionByName(
        registry.select("profile", F.lit(True).alias("taken"))
    )
    both = sides.groupBy("profile").agg(F.bool_or("taken").alias("a"), F.bool_and("taken").alias("b"))
    first = both.where("a AND NOT b").agg(F.min("profile")).scalar()
    message = F.concat(F.lit("profile exists already: "), first)
    return named.where(F.when(first.isNull(), True).otherwise(F.raise_error(message).cast("boolean")))


def component_items(
    df: DataFrame, component: str = "component"
) -> tuple[DataFrame, DataFrame]:
    """Rows with the item a component's short name stands for, and the others."""
    return alias_lookup(df, fixed.COMPONENT_ITEMS, component, "item")


def server_refs(df: DataFrame, columns: Sequence[str] = ("ref",)) -> DataFrame:
    """``df`` with the default scheme put before bare server references."""
    return df.withColumns(
        {c: normalize_ref(F.col(c), fixed.DEFAULT_SCHEME) for c in columns}
    )
