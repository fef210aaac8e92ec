"""Latest value per scope."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerframe.operators.keys import Keys, key_list


def active_state(
    log: DataFrame,
    scope: Keys,
    value: str,
    order: Keys,
    tombstone: Any = None,
) -> DataFrame:
    """The value written last in each scope; none where that is a tombstone.

    NULL is always a tombstone. ``order`` decides what is last; equal orders
    fall back to the larger value, so the result never depends on row order.
    The maximum is combined before the shuffle: a scope with very many writes
    sends one row per task.
    """
    scope, order = key_list(scope), key_list(order)
    last = F.max(F.struct(*order, value))
    state = log.groupBy(*scope).agg(last.alias("__last"))
    state = state.select(*scope, F.col("__last")[value].alias(value))
    alive = F.col(value).isNotNull()
    if tombstone is not None:
        alive = alive & (F.col(value) != F.lit(tombstone))
    return state.where(alive)
