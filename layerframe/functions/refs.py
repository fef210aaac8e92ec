"""References written as text: schemes, owners and relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_ref(ref: Column, scheme: str) -> Column:
    """Put ``scheme`` before a reference unless it already names one."""
    return F.when(ref.contains("://"), ref).otherwise(F.concat(F.lit(scheme), ref))


def owned_by_prefix(link: Column, root: str) -> Column:
    """True where ``link`` points below ``root``; a plain prefix test, so it
    is pushed down to the scan. A NULL link is not owned."""
    return F.coalesce(link.startswith(root.rstrip("/") + "/"), F.lit(False))


def strip_prefix(path: Column, prefix: Column) -> Column:
    """``path`` relative to ``prefix``; unchanged where it lies elsewhere."""
    head = F.concat(prefix, F.lit("/"))
    return F.when(path.startswith(head), F.substr(path, F.length(head) + 1)).otherwise(
        path
    )
