"""Rows with owners: writes and removals that leave foreign rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.operators.keys import (
    Keys,
    all_of,
    cast_to,
    common_schema,
    key_list,
    merge_join,
    pair_rows,
    pick,
    require_known,
    spread_key,
)


def managed_apply(
    current: DataFrame,
    incoming: DataFrame,
    keys: Keys,
    is_owned: Column,
    *,
    where: Column | None = None,
    small_incoming: bool = False,
    check: bool | str = True,
) -> DataFrame:
    """State after writing ``incoming`` over ``current``, with an ``outcome``.

    * ``inserted``: the key was free
    * ``replaced``: the key held a row for which ``is_owned`` is true
    * ``conflict``: the key held a foreign row, which stays as it is
    * ``kept``: nothing came in for the key

    ``is_owned`` is a condition on ``current``; NULL counts as foreign.
    ``where`` is a condition on the keys, applied to both inputs before they
    meet. For ``small_incoming`` and ``check`` see
    :func:`~layerframe.operators.keys.pair_rows`.
    """
    keys = key_list(keys)
    schema = common_schema(current, incoming)
    # cast first: the condition may name any column of `current`
    current = cast_to(current, schema).withColumn("__owned", _settled(is_owned))
    incoming = cast_to(incoming, schema)
    if where is not None:
        current, incoming = current.where(where), incoming.where(where)
    paired = pair_rows(current, incoming, keys, small_right=small_incoming, check=check)
    outcome = (
        F.when(~F.col("in_right"), "kept")
        .when(~F.col("in_left"), "inserted")
        .when(F.col("left___owned"), "replaced")
        .otherwise("conflict")
    )
    take_new = outcome.isin("inserted", "replaced")
    columns = [pick(c, keys, take_new) for c in schema.names]
    return paired.select(*columns, outcome.alias("outcome"))


def managed_remove(
    current: DataFrame, scope: DataFrame, keys: Keys, is_owned: Column
) -> DataFrame:
    """``current`` without the rows that are both owned and in ``scope``.

    ``scope`` lists the keys (or leading part of the keys) to clear. Ownership
    is part of the join condition, so ``current`` is read once and foreign
    rows stay whether in scope or not.
    """
    return _by_scope(current, scope, keys, is_owned, "left_anti")


def removable(
    current: DataFrame, scope: DataFrame, keys: Keys, is_owned: Column
) -> DataFrame:
    """The rows that :func:`managed_remove` takes away."""
    return _by_scope(current.where(_settled(is_owned)), scope, keys, is_owned, "left_semi")


def switch_owner(
    current: DataFrame,
    incoming: DataFrame,
    keys: Keys,
    is_owned: Column,
    *,
    scope: DataFrame,
    scope_keys: Keys,
    registry: DataFrame | None = None,
    owner: str = "owner",
    where: Column | None = None,
    check: bool = True,
) -> DataFrame:
    """Clear the owned rows in ``scope``, then write ``incoming``; one plan.

    With a ``registry`` of owners an unknown owner in ``incoming`` fails the
    whole job, so nothing is cleared for it.
    """
    if registry is not None:
        incoming = require_known(incoming, registry, owner, owner)
    if where is not None:
        current, incoming = current.where(where), incoming.where(where)
    # A scope by whole keys has no hot key, and leaves the partitioning that the
    # pairing needs; one by part of the keys gets exchanges of its own.
    spread = set(key_list(scope_keys)) != set(key_list(keys))
    cleared = _by_scope(current, scope, scope_keys, is_owned, "left_anti", spread=spread)
    return managed_apply(cleared, incoming, keys, is_owned, check=check)


def _settled(is_owned: Column) -> Column:
    return F.coalesce(is_owned, F.lit(False))


def _by_scope(
    current: DataFrame,
    scope: DataFrame,
    keys: Keys,
    is_owned: Column,
    how: str,
    spread: bool = True,
) -> DataFrame:
    keys = key_list(keys)
    # Distinct, because a foreign row would be tried against every repetition.
    names = scope.select(*keys).distinct()
    if spread:
        hashed = spread_key(current, names, keys)
        keys = [*keys, "__spread"]
        names, current = names.withColumn("__spread", hashed), current.withColumn("__spread", hashed)
    names = names.select(*[F.col(k).alias(f"__scope_{k}") for k in keys])
    same = all_of([F.col(k) == F.col(f"__scope_{k}") for k in keys])
    return merge_join(current, names, same & _settled(is_owned), how).drop("__spread")
