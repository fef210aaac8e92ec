"""Quality by ordinal regression on graded ratings.

Cumulative links: P(grade > k) = sigmoid(score - cut_k) with one weight vector
over hashed features of the text for all grades, and cuts in rising order. That
gives a grade's tail probability, and the expected grade as the sum of the
tails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, spans_hash, text_or_empty, word_spans
from .learning import MOST_ROWS, Adam, labelled_sample, sigmoid

BUCKETS = 1 << 16

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features, and their values, whose squares sum to 1.

    Features are words, their shapes (runs of capitals, small letters and digits
    each as one sign) and whether a word repeats the one before it. A value is
    the root of the feature's share. A text without words has none.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(data) if len(data) else (np.zeros(0, int), np.zeros(0, int))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    words = spans_hash(data, starts, ends)
    signs = _CLASS[data]
    kept = np.ones(len(signs), bool)
    kept[1:] = signs[1:] != signs[:-1]
    signs = signs[kept]
    shapes = mix64(spans_hash(signs, *word_spans(signs)) + np.uint64(1))
    repeats = np.zeros(len(words), np.uint64)
    repeats[1:] = 1 + (words[1:] == words[:-1])
    repeats = mix64(repeats + np.uint64(12345))
    found, counts = np.unique(
        np.concatenate([words, shapes, repeats]) % np.uint64(BUCKETS), return_counts=True
    )
    return found.astype(np.int64), np.sqrt(counts / (3 * len(words)))


@dataclass
class QualityModel:
    """Weights of the features and the cuts between the grades."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) of each text for each k below the highest grade."""
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts):
            where, values = features(text)
            scores[i] = self.weights[where] @ values
        return sigmoid(scores[:, None] - self.cuts[None])


def fit_ordinal(texts: list[str], grades: np.ndarray, seed: int = 7, epochs: int = 12) -> QualityModel:
    """Cumulative-link regression by Adam; rare grades weigh in as they are."""
    top = max(int(grades.max(initial=0)), 1)
    shares = np.array([(np.sum(grades > k) + 1) / (len(grades) + 2) for k in range(top)])
    start = -np.log(shares / (1 - shares))
    weights, base = np.zeros(BUCKETS), np.array([start[0]])
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    learn, learn_base, learn_gaps = Adam(weights, 0.05), Adam(base, 0.05), Adam(gaps, 0.05)
    rng = np.random.default_rng(seed)
    rows = [features(t) for t in texts]
    for _ in range(epochs if len(rows) > 2000 else 3 * epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 32):
            chosen = order[at : at + 32]
            where = np.concatenate([rows[i][0] for i in chosen])
            values = np.concatenate([rows[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            score = np.bincount(owner, weights[where] * values, len(chosen))
            cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            tails = sigmoid(score[:, None] - cuts[None])
            ends = np.concatenate([np.ones((len(chosen), 1)), tails, np.zeros((len(chosen), 1))], 1)
            own = grades[chosen]
            upper = np.take_along_axis(ends, own[:, None], 1)[:, 0]
            lower = np.take_along_axis(ends, own[:, None] + 1, 1)[:, 0]
            chance = np.maximum(upper - lower, 1e-9)
            slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
            by_score = -(slope_up - slope_low) / chance / len(chosen)
            by_cut = np.zeros(top)
            np.add.at(by_cut, own[own > 0] - 1, (slope_up / chance)[own > 0] / len(chosen))
            np.add.at(by_cut, own[own < top], (-slope_low / chance)[own < top] / len(chosen))
            hit, inverse = np.unique(where, return_inverse=True)
            gradient = np.bincount(inverse, by_score[owner] * values, len(hit)) + 1e-5 * weights[hit]
            learn(gradient, hit)
            learn_base(np.array([by_cut.sum()]))
            if len(gaps):
                after = by_cut[::-1].cumsum()[::-1][1:]
                learn_gaps(after * np.exp(gaps))
    cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return QualityModel(weights, cuts)


def train_quality(
    docs: DataFrame, labels: DataFrame, grade: Column, most: int = MOST_ROWS, held_out: int | None = 2
) -> QualityModel:
    """Fit on a bounded sample of graded rows, without the fold ``held_out``.

    ``grade`` is a whole number from 0 over the columns of ``labels``. Without
    ratings every document has the same even chances.
    """
    texts, grades, _ = labelled_sample(docs, labels, grade, most, held_out)
    if not len(grades):
        return QualityModel(np.zeros(BUCKETS), np.zeros(1))
    return fit_ordinal(texts, np.maximum(grades, 0))


def rate(
    docs: DataFrame, model: QualityModel, at_least: int = 1, chance: float = 0.5
) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` and ``selected``.

    ``tail_probability`` is that of a grade of ``at_least`` or more; rows reaching
    ``chance`` are selected. Null texts count as empty. Columns of these names
    are replaced.
    """
    if not 1 <= at_least <= len(model.cuts):
        raise ValueError(f"at_least has to be from 1 to {len(model.cuts)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected:double, tail:double>")
    def rated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            tails = [own.tails([t.as_py()])[0] for t in texts]
            tails = np.array(tails).reshape(len(texts), len(own.cuts))
            yield pa.StructArray.from_arrays(
                [pa.array(tails.sum(1)), pa.array(tails[:, at_least - 1])], ["expected", "tail"]
            )

    return (
        docs.withColumn("__rated", rated(text_or_empty("text")))
        .withColumn("expected_grade", F.col("__rated.expected"))
        .withColumn("tail_probability", F.col("__rated.tail"))
        .withColumn("selected", F.col("tail_probability") >= chance)
        .drop("__rated")
    )
