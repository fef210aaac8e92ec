"""What is there: counts, sorted listings and keys of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerframe.functions.documents import object_keys, with_member
from layerframe.functions.refs import strip_prefix
from layerframe.operators.keys import Keys, key_list
from layerframe.operators.lookup import lookup_join
from layerframe.sources.shared import new_shared_path, written_table


def inventory_counts(items: DataFrame, by: Keys, path: str = "path") -> DataFrame:
    """Per group the number of files and the first and last path.

    A row without a path stands for an empty folder and counts no file; groups
    without rows are left out.
    """
    return items.groupBy(*key_list(by)).agg(
        F.count(path).alias("n_files"),
        F.min(path).alias("first_path"),
        F.max(path).alias("last_path"),
    )


def inventory(
    items: DataFrame,
    by: Keys,
    path: str = "path",
    *,
    prefix: str | None = None,
    content: str | None = None,
    salts: int = 1,
    ordered: bool = False,
    collation: str | None = None,
) -> DataFrame:
    """Listing: a row per file with its group's ``n_files``.

    The listing stays in rows, so that no group has to fit into one value or
    one task. With ``ordered`` it is sorted, by range over group *and* path. The counts, a row
    per group, are written to the shared folder first; as their size is known
    then, the files need not be shuffled to get them. ``prefix`` names a
    column whose text is cut off the front of the path. Contents may hold
    secrets and are left out unless ``content`` names their column. Order is
    binary, or that of a Spark ``collation`` such as ``UNICODE`` or ``de``, which
    sorts text as people of a language do; texts that it takes for equal are
    in binary order.
    """
    by = key_list(by)
    shown = F.col(path) if prefix is None else strip_prefix(F.col(path), F.col(prefix))
    others = [shown.alias(path), *([] if content is None else [F.col(content)])]
    # Structs compare NULL fields as equal, so a group of NULLs finds its count.
    group = F.struct(*by).alias("__group")
    counts = items.groupBy(*by).agg(F.count(path).alias("n_files"))
    counts = written_table(
        counts.select(group, "n_files"), new_shared_path(items.sparkSession, "counts")
    )
    listed = lookup_join(
        items.select(*by, *others, group),
        counts,
        "__group",
        salts=salts,
        salt_by=[*by, path],
    )
    tail = [path] if content is None else [path, content]
    listed = listed.select(*by, "n_files", *tail)
    return listed.orderBy(*_in_order(listed, [*by, path], collation)) if ordered else listed


def _in_order(rows: DataFrame, columns: list[str], collation: str | None) -> list[Column]:
    """Sort keys: texts by a collation, and then in binary order."""
    if collation is None:
        return [F.col(c) for c in columns]
    texts = {name for name, kind in rows.dtypes if kind.startswith("string")}
    own = [F.collate(c, collation) if c in texts else F.col(c) for c in columns]
    return [*own, *[F.col(c) for c in columns if c in texts]]


def json_keys(
    df: DataFrame,
    document: str,
    *,
    field: str | None = None,
    by: Keys = (),
    key: str = "key",
    distinct: bool = True,
    ordered: bool = False,
    collation: str | None = None,
) -> DataFrame:
    """Keys of JSON objects (or of the object in their ``field``) as rows.

    Broken text and other JSON values give no rows. ``by`` keeps columns. With
    ``ordered`` they are sorted as in :func:`inventory`.
    """
    by = key_list(by)
    found = object_keys(F.col(document))
    if field is not None:
        whole = found.isNotNull()
        df = with_member(df, "__member", F.col(document), field)
        found = F.when(whole, F.map_keys("__member"))
    keys = df.select(*by, F.explode(found).alias(key))
    if distinct:
        keys = keys.distinct()
    return keys.orderBy(*_in_order(keys, [*by, key], collation)) if ordered else keys
