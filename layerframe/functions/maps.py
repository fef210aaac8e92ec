"""Right-wins overlay of map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlay_maps(base: Column, extra: Column) -> Column:
    """All keys of both maps; where a key is in both, the value of ``extra``.

    Presence of the key decides, so a NULL value on the right replaces the
    left value. A NULL map counts as a map without keys; two of them give
    NULL. Values are taken whole and never merged inside.
    """
    # A struct around each right-hand value tells "NULL" from "no such key".
    boxed = F.transform_values(extra, lambda key, value: F.struct(value.alias("value")))
    merged = F.map_zip_with(
        base,
        boxed,
        lambda key, left, right: F.when(right.isNotNull(), right["value"]).otherwise(left),
    )
    return F.when(extra.isNull(), base).when(base.isNull(), extra).otherwise(merged)


def last_wins(entries: Column) -> Column:
    """Drop all but the last entry of each key from a map with repeated keys.

    JSON text may repeat a key. Only rows that really do pay for the sort.
    """
    keys, values = F.map_keys(entries), F.map_values(entries)
    tagged = F.array_sort(
        F.transform(keys, lambda key, pos: F.struct(key.alias("key"), pos.alias("pos")))
    )
    last_positions = F.filter(
        tagged,
        lambda entry, i: F.coalesce(
            F.get(tagged, i + 1)["key"] != entry["key"], F.lit(True)
        ),
    )
    kept = F.array_sort(F.transform(last_positions, lambda entry: entry["pos"]))
    deduplicated = F.map_from_arrays(
        F.transform(kept, lambda pos: F.get(keys, pos)),
        F.transform(kept, lambda pos: F.get(values, pos)),
    )
    return F.when(
        F.size(keys) > F.size(F.array_distinct(keys)), deduplicated
    ).otherwise(entries)

