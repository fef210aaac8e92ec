"""Layers over a table: right-wins overlay and filling of absent rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerframe.operators.keys import (
    Keys,
    cast_to,
    common_schema,
    key_list,
    merge_join,
    pair_rows,
    pick,
    require_unique,
)


def overlay_rows(
    base: DataFrame,
    extra: DataFrame,
    keys: Keys,
    *,
    where: Column | None = None,
    small_extra: bool = False,
    check: bool | str = True,
) -> DataFrame:
    """Rows of both tables; of a key in both, the whole row of ``extra``.

    ``origin`` says ``base``, ``overridden`` or ``added``. Presence of the row
    decides, so NULLs in ``extra`` win too. ``where`` is a condition on the
    keys; it is applied to both inputs, where the scans can use it, because a
    filter on the result does not get through a full join. For ``small_extra``
    and ``check`` see :func:`~layerframe.operators.keys.pair_rows`.
    """
    keys = key_list(keys)
    schema = common_schema(base, extra)
    base, extra = cast_to(base, schema), cast_to(extra, schema)
    if where is not None:
        base, extra = base.where(where), extra.where(where)
    paired = pair_rows(base, extra, keys, small_right=small_extra, check=check)
    in_base, in_extra = F.col("in_left"), F.col("in_right")
    origin = (
        F.when(in_base & in_extra, "overridden").when(in_extra, "added").otherwise("base")
    )
    columns = [pick(c, keys, in_extra) for c in schema.names]
    return paired.select(*columns, origin.alias("origin"))


def fill_defaults(
    present: DataFrame,
    entities: DataFrame,
    items: Sequence[Any] | DataFrame,
    *,
    entity: Keys,
    item: str,
    defaults: Mapping[str, Any],
    held: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """``present`` and a default row for every required item an entity lacks.

    ``defaults`` gives the other columns of a filled row, as values or as
    Columns over the entity's columns and ``item``; columns not named become
    NULL. Rows that exist are passed on untouched whatever they hold, and
    ``filled`` tells the two apart. What is there is read off ``held``, by
    default ``present`` itself: give the (entity, item) pairs where they are
    cheaper to get than ``present``.

    Required items are cast to the type they have in ``held``, NULL and
    repeated ones left out, before anything else. A list of them, which the
    program holds anyway, is joined to no one: each entity's set of items is
    compared with it. A table of items may be of any size: it is cut into blocks
    by hash, and each entity's items of a block are compared with the block's.
    Only what is absent is spelled out; the grid never exists as rows.
    """
    entity = key_list(entity)
    held = present if held is None else held
    if check:
        entities = require_unique(entities, entity, "entities")
    if isinstance(items, DataFrame):
        absent = _absent_of_table(held, entities, items, entity, item)
    else:
        absent = _absent_items(held, entities, list(items), entity, item)
    filled = absent.select(
        *[
            _default(c, entity, item, defaults).cast(present.schema[c].dataType).alias(c)
            for c in present.columns
        ],
        F.lit(True).alias("filled"),
    )
    return present.withColumn("filled", F.lit(False)).unionByName(filled)


def _default(
    column: str, entity: list[str], item: str, defaults: Mapping[str, Any]
) -> Column:
    if column in entity or column == item:
        return F.col(column)
    value = defaults.get(column)
    return value if isinstance(value, Column) else F.lit(value)


def _absent_items(
    held: DataFrame,
    entities: DataFrame,
    items: list[Any],
    entity: list[str],
    item: str,
) -> DataFrame:
    array_type = T.ArrayType(held.schema[item].dataType)
    required = F.array_compact(F.array(*[F.lit(i) for i in items]).cast(array_type))
    # collect_set is combined before the shuffle and holds at most the
    # required items, however many rows an entity has.
    owned = (
        held.where(F.array_contains(required, F.col(item)))
        .groupBy(*entity)
        .agg(F.collect_set(item).alias("__owned"))
    )
    # left in `entities`, an item column would hide the exploded one
    bare = entities.drop(item)
    nothing = F.array().cast(array_type)
    absent = F.array_except(required, F.coalesce("__owned", nothing))
    return (
        merge_join(bare, owned, entity, "left")
        .withColumn(item, F.explode(absent))
        .drop("__owned")
    )


def _absent_of_table(
    held: DataFrame,
    entities: DataFrame,
    items: DataFrame,
    entity: list[str],
    item: str,
    entity_blocks: int = 64,
    item_blocks: int = 64,
) -> DataFrame:
    # Blocks of items are arrays, repeated for each block of entities, so the
    # join of entities to arrays has many keys and spreads over all tasks.
    def block(keys: list[str], blocks: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    item_type = held.schema[item].dataType
    nothing = F.array().cast(T.ArrayType(item_type))
    required = (
        items.select(F.col(item).cast(item_type).alias(item))
        .where(F.col(item).isNotNull())
        .groupBy(block([item], item_blocks).alias("__b"))
        .agg(F.collect_set(item).alias("__required"))
        .withColumn("__a", every(entity_blocks))
    )
    owned = held.groupBy(*entity, block([item], item_blocks).alias("__b")).agg(
        F.collect_set(item).alias("__owned")
    )
    return (
        entities.drop(item)
        .withColumn("__a", block(entity, entity_blocks))
        .withColumn("__b", every(item_blocks))
        .join(required, ["__a", "__b"])
        .join(owned, [*entity, "__b"], "left")
        .withColumn(item, F.explode(F.array_except("__required", F.coalesce("__owned", nothing))))
        .drop("__a", "__b", "__required", "__owned")
    )
