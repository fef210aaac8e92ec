"""Language of texts by sparse multinomial logistic regression.

Features are the hashed runs of one to three characters, where letters are in
lower case and everything between words is one blank, weighed by TF-IDF and
scaled to length one. Document frequencies are counted over all rows that may be
learnt from. The weights are fitted on a bounded sample of them by following the
regularised leader with elastic-net penalties, which leaves most at zero, and a
temperature fitted on a part of the sample that is kept apart makes
probabilities of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .learning import fold

BUCKETS = 1 << 16
LONGEST = 3
MOST_ROWS = 4_000
"""Bound of the training sample; each language has an equal share at most."""

BLOCK = 1 << 18
"""So many characters of a text are hashed at a time."""

UNKNOWN = "und"

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets met in a whole text and how often; None without a letter."""
    letters = _is_letter()
    lowered = text.lower()
    rest, met = np.full(1, 32, np.uint64), False
    total = np.zeros(BUCKETS if len(lowered) > BLOCK else 0, np.int64)
    buckets = np.zeros(0, np.uint16)
    for at in range(0, len(lowered), BLOCK):
        part = lowered[at : at + BLOCK].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, np.uint32)
        letter = letters[codes]
        met |= bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        # Blanks after a blank go; the last symbols of the block before lead in.
        before = np.concatenate([rest[-1:], codes[:-1]])
        codes = np.concatenate([rest, codes[letter | (before != 32)]])
        hashes, found = codes, []
        for n, odd in enumerate(_ODD):
            if n:
                hashes = hashes[:-1] * np.uint64(0x100000001B3) + codes[n:]
            new = hashes[max(len(rest) - n, 0) :]
            found.append(((new * np.uint64(odd)) >> np.uint64(48)).astype(np.uint16))
        buckets = np.concatenate(found)
        if len(total):
            total += np.bincount(buckets, minlength=BUCKETS)
        rest = codes[1 - LONGEST :]
    if not met:
        return None
    if len(total):
        met_at = np.flatnonzero(total)
        return met_at.astype(np.uint16), total[met_at]
    buckets.sort(kind="stable")  # by radix for integers as short as these
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return buckets[first], np.diff(np.append(first, len(buckets)))


@dataclass
class LanguageModel:
    """Weights of the features that have any, by language."""

    langs: list[str]
    idf: np.ndarray
    rows: np.ndarray
    """For each bucket its row in ``weights``; the last one, of zeros, if it has none."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each language."""
        values = vector(counts, self.idf[at])
        return softmax((values @ self.weights[self.rows[at]] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counts_of(text or "")
        if counts is None or not self.langs:
            return UNKNOWN, 0.0
        p = self.scores(*counts)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf
    return values / np.sqrt((values**2).sum())


def softmax(raw: np.ndarray) -> np.ndarray:
    p = np.exp(raw - raw.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def learnable(docs: DataFrame, held_out: int | None = 2) -> DataFrame:
    """Rows with a language outside the fold ``held_out``."""
    rows = docs.where(F.col("lang").isNotNull())
    return rows if held_out is None else rows.where(fold("doc_id") != held_out)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Rows in which each bucket is met, and rows with a letter, of all rows.

    Each task adds up its own, so that as many rows as buckets leave it at most.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = counts_of(text.as_py())
                if counts is not None:
                    found[counts[0]] += 1
                    found[BUCKETS] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    each = rows.select(text_or_empty("text").alias("text")).mapInArrow(tally, "bucket long, n long")
    total = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(BUCKETS + 1, np.int64)
    found[total["bucket"].to_numpy()] = total["n"].to_numpy()
    return found[:BUCKETS], int(found[BUCKETS])


def training_sample(rows: DataFrame, most: int = MOST_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Language, buckets and their counts of at most ``most`` rows with a letter.

    Rows are chosen by a hash of their id, at a rate that gives each language
    about as many, and whole texts are counted in the tasks.
    """
    sizes = dict(sorted(rows.groupBy("lang").count().collect()))
    if not sizes:
        return []
    each = 0.9 * most / len(sizes)
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < rates[F.col("lang")]).select("doc_id", "lang", text_or_empty("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(*batch.columns, strict=True):
                counts = counts_of(text.as_py())
                if counts is None:
                    continue
                packed = counts[0].astype("<u2").tobytes(), counts[1].astype("<u4").tobytes()
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": doc_id.as_py(), "lang": lang.as_py(), "at": packed[0], "n": packed[1]}],
                    pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())]),
                )

    packed = chosen.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        count, "doc_id long, lang string, at binary, n binary"
    )
    order = [F.xxhash64("doc_id", F.lit("order")), "doc_id", "lang", "at", "n"]
    return [
        (r["lang"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u4"))
        for r in packed.orderBy(*order).limit(most).collect()
    ]


class Leader:
    """Follow-the-regularised-leader for one logistic model with several classes.

    Each weight is worked out, when it is needed, from the sum of its gradients
    and of their squares; it is zero while that sum is within ``l1``.
    """

    def __init__(self, features: int, classes: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.sums = np.zeros((features, classes))
        self.squares = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        sums = self.sums[at]
        step = (self.beta + np.sqrt(self.squares[at])) / self.alpha + self.l2
        return -np.sign(sums) * np.maximum(np.abs(sums) - self.l1, 0) / step

    def learn(self, at, gradient: np.ndarray, weights: np.ndarray) -> None:
        squares = self.squares[at]
        grown = squares + gradient**2
        self.sums[at] += gradient - (np.sqrt(grown) - np.sqrt(squares)) / self.alpha * weights
        self.squares[at] = grown


def fit(
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    idf: np.ndarray,
    *,
    epochs: int = 4,
    alpha: float = 2.0,
    l1: float = 0.1,
    l2: float = 0.5,
    seed: int = 3,
) -> LanguageModel:
    """Weights by following the leader, then the temperature on every fifth row."""
    langs = sorted({lang for lang, _, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.array([number[lang] for lang, _, _ in rows], np.int64)
    vectors = [(at, vector(n, idf[at])) for _, at, n in rows]
    rng = np.random.default_rng(seed)
    apart = rng.permutation(len(rows)) % 5 == 0
    if len(rows) < 5 * max(1, len(langs)):
        apart[:] = False
    leader = Leader(len(idf), len(langs), alpha, l1, l2)
    bias = Leader(1, len(langs), alpha, 0, 0)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~apart)):
            at, x = vectors[i]
            w, b = leader.weights(at), bias.weights()
            error = softmax(x @ w + b[0])
            error[y[i]] -= 1
            leader.learn(at, x[:, None] * error, w)
            bias.learn(slice(None), error[None], b)
    full = leader.weights()
    used = np.flatnonzero(np.abs(full).max(1) > 0) if len(langs) else np.zeros(0, np.int64)
    place = np.full(len(idf), len(used), np.int32)
    place[used] = np.arange(len(used))
    weights = np.concatenate([full[used], np.zeros((1, len(langs)))]).astype(np.float32)
    model = LanguageModel(langs, idf.astype(np.float32), place, weights, bias.weights()[0])
    if apart.any():
        raw = np.array([vectors[i][1] @ full[vectors[i][0]] + model.bias for i in np.flatnonzero(apart)])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        # Smoothed by one row of each language, so that no certainty comes of few rows.
        target = np.full(raw.shape, 1 / (len(raw) + len(langs)))
        target[np.arange(len(raw)), y[apart]] += len(raw) / (len(raw) + len(langs))
        loss = [-(target * np.log(softmax(raw / t) + 1e-300)).sum() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train_languages(docs: DataFrame, most: int = MOST_ROWS, held_out: int | None = 2) -> LanguageModel:
    """Learn from the texts and languages of ``docs`` (doc_id, text, lang).

    Left out are rows without a language, of the fold ``held_out``, and with a
    null id where a fold is held out. A table without any gives a model
    without languages, which knows none.
    """
    rows = learnable(docs, held_out)
    sample = training_sample(rows, most)
    found, total = document_frequencies(rows) if sample else (np.zeros(BUCKETS, np.int64), 0)
    return fit(sample, np.log((1 + total) / (1 + found)) + 1)


def language_of(docs: DataFrame, model: LanguageModel, text: Column | str = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` of a whole text.

    The score is the probability of the language. A text that is null or has no
    letter is ``und`` with a score of 0, and so is any for a model that has
    learnt nothing. Equal texts have equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang_pred", "score"],
            )

    return predicted(text_or_empty(text))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    marked = docs.select(*kept, language_of(docs, model).alias("__language"))
    return marked.select(*kept, "__language.lang_pred", "__language.score")
