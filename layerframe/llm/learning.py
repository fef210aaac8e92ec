"""What the two classifiers share: labelled samples and small numpy helpers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

MOST_ROWS = 6_000
"""Bound of a training sample: so many labelled rows are fitted on."""

MOST_CHARS = 60_000_000
"""Bound of a training sample: so many characters its texts have together."""


def fold(doc_id: Column | str, folds: int = 4) -> Column:
    """Remainder of the crc32 of the id as text; null has none."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: Column, most: int = MOST_ROWS, held_out: int | None = 2
) -> tuple[list[str], np.ndarray, list[int]]:
    """Texts, labels and ids of at most ``most`` labelled rows.

    The rows are those whose ids have the smallest hashes, without the fold
    ``held_out``, as far as their texts have ``MOST_CHARS`` characters together.
    Where ids repeat, the choice goes on by the text, so it is the same each time.
    Only texts of chosen ids are read.
    """
    known = known_labels(labels, label, held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", text_or_empty("text").alias("__text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "__text", "__label")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.md5(F.col("__text").cast("binary"))]
    # Of at most so many rows, so one task is enough.
    upto = F.sum(F.length("__text")).over(Window.orderBy(*order))
    rows = rows.orderBy(*order).limit(most).withColumn("__upto", upto).where(F.col("__upto") <= MOST_CHARS)
    rows = sorted(rows.select("doc_id", "__text", "__label").collect())
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), [r[0] for r in rows]


def known_labels(labels: DataFrame, label: Column, held_out: int | None = 2) -> DataFrame:
    """(doc_id, __label) of all labelled ids outside the fold ``held_out``.

    Of several labels of an id the largest counts, null ones are left out.
    """
    known = labels.select("doc_id", label.cast("int").alias("__label")).dropna()
    if held_out is not None:
        known = known.where(fold("doc_id") != held_out)
    return known.groupBy("doc_id").agg(F.max("__label").alias("__label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps for one array; ``rows`` limits a step to some rows."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.mean, self.square = np.zeros_like(value), np.zeros_like(value)
        self.step = 0

    def __call__(self, gradient: np.ndarray, rows=slice(None)) -> None:
        self.step += 1
        self.mean[rows] = 0.9 * self.mean[rows] + 0.1 * gradient
        self.square[rows] = 0.999 * self.square[rows] + 0.001 * gradient**2
        mean = self.mean[rows] / (1 - 0.9**self.step)
        square = self.square[rows] / (1 - 0.999**self.step)
        self.value[rows] -= self.rate * mean / (np.sqrt(square) + 1e-8)
