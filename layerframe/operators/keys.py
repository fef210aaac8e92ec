"""Keys: checking them inside the plan and pairing two tables on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from layerframe.sources.shared import new_shared_path, written_table

Keys = str | Sequence[str]


def key_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def require_unique(df: DataFrame, keys: Keys, what: str = "rows") -> DataFrame:
    """``df`` itself, failing while it runs if a key repeats or is NULL.

    The check is a row number in the hash partitioning and sort order that a
    shuffled join on the same keys needs anyway, so before such a join it adds
    neither an exchange nor a second scan. For a table that may hold a single
    key very many times, ask :func:`repeated_keys` first.
    """
    keys = key_list(keys)
    in_key = Window.partitionBy(*keys).orderBy(*keys)
    good = (F.col("__nth") == 1) & all_of([F.col(k).isNotNull() for k in keys])
    message = F.concat(F.lit(f"{what}: key is NULL or repeated: "), _shown(keys))
    return (
        df.withColumn("__nth", F.row_number().over(in_key))
        .where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))
        .drop("__nth")
    )


def require_unique_counted(df: DataFrame, keys: Keys, what: str = "rows") -> DataFrame:
    """``df`` itself, not shuffled, failing while it runs as ``require_unique`` does.

    The keys alone are counted, which is combined before their shuffle; the
    answer reaches the rows as a scalar. Costs a narrow scan, but neither wide rows
    nor a key with very many of them end up in one task.
    """
    keys = key_list(keys)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    wrong = df.groupBy(*keys).agg(F.count("*").alias("n")).where(missing | (F.col("n") > 1))
    first_wrong = wrong.agg(F.min(_shown(keys))).scalar()
    message = F.concat(F.lit(f"{what}: key is NULL or repeated: "), first_wrong)
    return df.where(
        F.when(first_wrong.isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    )


def spread_key(rows: DataFrame, table: DataFrame, on: Keys) -> Column:
    """A hash of ``on`` that is the same on both sides, for use as one more key.

    A join on it cannot ride on the partitioning that an aggregate or a check
    has left on ``table``, and gets exchanges of its own. Only above those does
    adaptive execution split the rows of a hot key.
    """
    on = key_list(on)
    # equal keys of different types hash differently, so the types come first
    schema = common_schema(rows.select(*on), table.select(*on))
    return F.xxhash64(*[F.col(f.name).cast(f.dataType) for f in schema])


def merge_join(
    left: DataFrame, right: DataFrame, on: Keys | Column, how: str = "inner"
) -> DataFrame:
    """A join of two tables that may both be large: shuffled, never broadcast.

    Spark judges a table by its compressed size on disk, and names that repeat their
    parts take tens of times as much in memory.
    """
    return left.join(right.hint("merge"), on, how)


FEW_ROWS = 20_000
"""So many narrow rows, counted, are broadcast rather than shuffled."""


def join_to_counted(rows: DataFrame, counted: DataFrame, n: int, on: Keys) -> DataFrame:
    """Inner join to a table of ``n`` rows, which is broadcast if they are few."""
    if n <= FEW_ROWS:
        return rows.join(F.broadcast(counted), on)
    return merge_join(rows, counted, on)


def repeated_keys(df: DataFrame, keys: Keys) -> DataFrame:
    """The keys that occur more than once, with ``n`` rows each.

    Counted before the shuffle, so a key with very many rows does no harm.
    Worth a look before trusting a table with ``check=False``.
    """
    return df.groupBy(*key_list(keys)).agg(F.count("*").alias("n")).where("n > 1")


def require_known(df: DataFrame, registry: DataFrame, on: Keys, what: str = "name") -> DataFrame:
    """``df`` itself, failing while it runs if a row's ``on`` is not registered.

    Very many rows may have the same name, so names are not joined but grouped,
    which is combined before the shuffle. The answer reaches the rows as a
    scalar, and they stay where they are.
    """
    on = key_list(on)
    names = df.select(*on, F.lit(False).alias("__known"))
    known = registry.select(*on, F.lit(True).alias("__known"))
    known = known.where(all_of([F.col(k).isNotNull() for k in on]))
    grouped = names.unionByName(known).groupBy(*on).agg(F.bool_or("__known").alias("__known"))
    unknown = grouped.where("NOT __known")
    first_unknown = unknown.agg(F.min(_shown(on))).scalar()
    message = F.concat(F.lit(f"{what} not found: "), first_unknown)
    return df.where(
        F.when(first_unknown.isNull(), True).otherwise(
            F.raise_error(message).cast("boolean")
        )
    )


def _shown(keys: list[str]) -> Column:
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]
    return F.concat_ws(", ", *texts)


def pair_rows(
    left: DataFrame,
    right: DataFrame,
    keys: Keys,
    *,
    small_right: bool = False,
    check: bool | str = True,
) -> DataFrame:
    """One row per key of either table.

    Holds the keys, the other columns of the two tables as ``left_<name>`` and
    ``right_<name>``, and flags ``in_left`` and ``in_right`` that tell a row of
    NULLs from no row. The columns stay apart, rather than in two structs, so
    that those not asked for are never read.

    By default both tables are shuffled once on the keys and merged.

    With ``small_right`` the right table is first written to the shared
    folder, so that its size is known when the joins are planned. Below
    Spark's broadcast threshold the left table is then not shuffled at all;
    above it the joins are shuffled and the result is the same.

    ``check`` rejects repeated or NULL keys on both sides. With ``small_right``
    the left's keys, and only those, are counted for it, combined before their
    shuffle; ``check="right"`` saves that for a left table known to be sound.
    """
    keys = key_list(keys)
    if check not in (True, False, "right"):
        raise ValueError('check has to be True, False or "right"')
    narrow = left.select(*keys)
    if check:
        right = require_unique(right, keys, "right side")
    if check is True:
        unique = require_unique_counted if small_right else require_unique
        left = unique(left, keys, "left side")
    if small_right:
        right = written_table(right, new_shared_path(right.sparkSession, "side"))
    lefts, rights = _marked(left, keys, "left"), _marked(right, keys, "right")
    if not small_right:
        paired = lefts.join(rights, keys, "full")
    else:
        matched = narrow.join(right.select(*keys), keys, "left_semi")
        paired = lefts.join(rights, keys, "left").unionByName(
            rights.join(matched, keys, "left_anti"), allowMissingColumns=True
        )
    return paired.withColumns(
        {flag: F.coalesce(flag, F.lit(False)) for flag in ("in_left", "in_right")}
    )


def _marked(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    payload = [F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys]
    return df.select(*keys, *payload, F.lit(True).alias(f"in_{side}"))


def pick(column: str, keys: list[str], from_right: Column) -> Column:
    """A column of paired rows, taken from the right side where so told."""
    if column in keys:
        return F.col(column)
    right, left = F.col(f"right_{column}"), F.col(f"left_{column}")
    return F.when(from_right, right).otherwise(left).alias(column)


def common_schema(a: DataFrame, b: DataFrame) -> T.StructType:
    """Schema that holds the rows of both; an error if their columns differ."""
    if set(a.columns) != set(b.columns):
        odd = sorted(set(a.columns) ^ set(b.columns))
        raise ValueError(f"both sides need the same columns; only on one side: {odd}")
    return a.limit(0).unionByName(b.limit(0)).schema


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
