"""Many rows looked up in a table that has each key once.

Many rows may share one key here. Spark broadcasts the looked-up table only
when it measures below the broadcast threshold; beyond it the join is
shuffled, and adaptive execution splits a hot key's rows over several tasks
(the many-row side is always the left one, which it may split for inner,
left, semi and anti joins). It does so only right above the join's own
exchanges, so the joins here never ride on the partitioning of an earlier
aggregate or check. Where adaptive execution is off, ``salts`` does the
splitting. With ``laid_out`` the many rows are a table saved in buckets of the key:
they are not shuffled at all, and the rows of hot keys, which are measured first,
are looked up where they lie.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.operators.keys import Keys, key_list, require_unique, spread_key
from layerframe.sources.shared import new_shared_path, written_table


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Keys,
    how: str = "left",
    *,
    salts: int = 1,
    salt_by: Keys | None = None,
    laid_out: bool = False,
    large: bool = False,
) -> DataFrame:
    """Join ``rows`` to ``table``, spreading each key over ``salts`` tasks.

    The salt is a hash of ``salt_by`` (by default the whole row), so a retried
    task puts every row where it was before. ``table`` is repeated ``salts``
    times. A ``large`` table is never broadcast, however well it is compressed on disk.
    """
    on = key_list(on)
    table = table.hint("merge") if large else table
    if laid_out:
        return _laid_out_join(rows, table, on, how)
    if salts <= 1:
        spread = spread_key(rows, table, on)
        return (
            rows.withColumn("__spread", spread)
            .join(table.withColumn("__spread", spread), [*on, "__spread"], how)
            .drop("__spread")
        )
    by = rows.columns if salt_by is None else key_list(salt_by)
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    salted = rows.withColumn("__salt", salt)
    repeated = table.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


HOT_SHARE = 0.001
"""A key with more than this share of all rows is hot, so there are 1,000 at most."""

LEAST_HOT = 10_000


def _laid_out_join(rows: DataFrame, table: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows``, saved in buckets of ``on``, joined to ``table`` where they lie.

    Cold keys meet ``table`` bucket by bucket, so only that side is shuffled. Hot keys
    would keep one task busy; their rows are joined to the few rows that ``table`` has
    for them, which are broadcast. Counting keys needs no shuffle of the buckets either.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    least = F.greatest(rows.agg(F.count("*") * F.lit(HOT_SHARE)).scalar(), F.lit(LEAST_HOT))
    hot = counts.where(F.col("__n") > least).select(*on)
    hot = written_table(hot, new_shared_path(rows.sparkSession, "hot"))
    if hot.isEmpty():
        return rows.join(table, on, how)
    few = F.broadcast(hot)
    held = table.join(few, on, "left_semi")
    cold = rows.join(few, on, "left_anti").join(table, on, how)
    return cold.unionByName(rows.join(few, on, "left_semi").join(F.broadcast(held), on, how))


def mark_active(
    names: DataFrame,
    state: DataFrame,
    on: Keys,
    name: str,
    active: str,
    flag: str = "is_active",
    salts: int = 1,
    check: bool = True,
    laid_out: bool = False,
) -> DataFrame:
    """All ``names`` with a flag: is ``name`` the ``active`` value of its scope?

    ``state`` has one row per scope ``on``, which ``check`` enforces; a scope
    without one has no active name.
    """
    on = key_list(on)
    current = state.select(*on, F.col(active).alias("__active"))
    if check:
        current = require_unique(current, on, "state")
    joined = lookup_join(names, current, on, "left", salts=salts, laid_out=laid_out)
    is_active = F.coalesce(F.col(name) == F.col("__active"), F.lit(False))
    return joined.select(*names.columns, is_active.alias(flag))


def owner_of(
    rows: DataFrame, roots: DataFrame, on: str, root: str = "root", owner: str = "owner"
) -> DataFrame:
    """``rows`` with ``owner``: that of the longest of ``roots`` above the path ``on``.

    ``roots`` has (root, owner), each root once and without regard to a ``/`` at its
    end; a path is below a root if the root and a ``/`` begin it, so the root itself
    is not. Old and new roots may stand side by side, and one inside another
    takes what is below it. NULL where there is none.

    The folders above each distinct path are spelled out and looked up, so the
    join is one on equal values. A column ``owner`` of ``rows`` is replaced.
    """
    named = roots.select(F.rtrim(F.col(root), F.lit("/")).alias("__root"), F.col(owner).alias("__owner"))
    named = require_unique(named, "__root", "roots")
    paths = rows.select(F.col(on).alias("__path")).where("__path IS NOT NULL").distinct()
    parts = F.split("__path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    above = F.when(F.size(parts) > 1, above)
    found = lookup_join(paths.select("__path", F.explode(above).alias("__root")), named, "__root", "inner")
    best = found.groupBy("__path").agg(F.max_by("__owner", F.length("__root")).alias(owner))
    best = best.withColumnRenamed("__path", on)
    kept = [c for c in rows.columns if c != owner]
    return lookup_join(rows.select(*kept), best, on, "left").select(*kept, owner)


def tag_known(
    df: DataFrame,
    registry: DataFrame,
    on: Keys,
    flag: str = "known",
    salts: int = 1,
    laid_out: bool = False,
) -> DataFrame:
    """``df`` with a flag telling whether ``on`` is in ``registry``; one join."""
    on = key_list(on)
    known = registry.select(*on).distinct().withColumn("__known", F.lit(True))
    joined = lookup_join(df, known, on, "left", salts=salts, laid_out=laid_out)
    return joined.select(*df.columns, F.coalesce("__known", F.lit(False)).alias(flag))


def exists_guard(
    df: DataFrame, registry: DataFrame, on: Keys, salts: int = 1, laid_out: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``on`` is registered, and the others."""
    on = key_list(on)
    # Distinct first: a name repeated very often in the registry would end up
    # in one task, and that side of the join cannot be split.
    names = registry.select(*on).distinct()
    return (
        lookup_join(df, names, on, "left_semi", salts=salts, laid_out=laid_out),
        lookup_join(df, names, on, "left_anti", salts=salts, laid_out=laid_out),
    )


def alias_lookup(
    df: DataFrame,
    aliases: DataFrame | Mapping[str, str],
    on: str,
    canonical: str = "canonical",
    salts: int = 1,
    strict: bool = False,
    laid_out: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows with the canonical name of their alias, and rows without one.

    A mapping becomes an expression and needs no join. A table of aliases has
    the columns ``on`` and ``canonical``, with each alias once. With ``strict`` an
    alias that is unknown or NULL fails the job instead, and the second table is
    empty.
    """
    named = with_canonical(df, aliases, on, canonical, salts, laid_out)
    if strict:
        shown = F.coalesce(F.col(on).cast("string"), F.lit("NULL"))
        unknown = F.raise_error(F.concat(F.lit(f"{on} not found: "), shown)).cast("string")
        # In the column, for a filter could be evaluated after another one.
        return named.withColumn(canonical, F.coalesce(canonical, unknown)), df.limit(0)
    return (
        named.where(F.col(canonical).isNotNull()),
        named.where(F.col(canonical).isNull()).drop(canonical),
    )


def with_canonical(
    df: DataFrame,
    aliases: DataFrame | Mapping[str, str],
    on: str,
    canonical: str = "canonical",
    salts: int = 1,
    laid_out: bool = False,
) -> DataFrame:
    """``df`` with the canonical name of ``on``, NULL for an unknown alias."""
    if isinstance(aliases, Mapping):
        return df.withColumn(canonical, canonical_name(F.col(on), aliases))
    table = require_unique(aliases.select(on, canonical), on, "aliases")
    joined = lookup_join(df, table, on, "left", salts=salts, laid_out=laid_out)
    return joined.select(*df.columns, canonical)


def canonical_name(alias: Column, aliases: Mapping[str, str]) -> Column:
    """Canonical name as an expression, NULL for an unknown alias."""
    if not aliases:
        return F.lit(None).cast("string")
    pairs = [F.lit(text) for pair in aliases.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), alias)
