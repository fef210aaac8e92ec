"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is a run of letters in lower case; its vector is the sum of the hashed
vectors of the word and of its beginnings, so inflected forms share what they
begin with. Filters of several widths run over the words, each keeps its
highest value in the text, and a logistic layer weighs those. A convolution is
linear in the vectors, so for scoring each bucket's products with all filters
are tabled once; a text costs lookups and sums, and its positions are taken in
blocks, so memory does not grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_shared_path, written_table
from .common import small_side, spans_hash, text_or_empty
from .learning import MOST_ROWS, Adam, known_labels, labelled_sample, sigmoid

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
BEGINNINGS = (4, 5)
"""Lengths in bytes of the beginnings that have vectors of their own."""

BLOCK = 20_000
LEAST_TEXTS = 3
"""Buckets met in fewer training texts have no vector: they would be learnt by heart."""

EVENED = 20
"""A language's threshold is its own and the common one, evened out as if so many
toxic rows spoke for the common one."""

LOWEST, HIGHEST, BINS = 0.3, 0.8, 100
"""Thresholds lie in this range, at the edges of bins of scores."""

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def buckets(text: str) -> np.ndarray:
    """A row of bucket numbers for each word: the word's and its beginnings'."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    out = np.empty((len(starts), 1 + len(BEGINNINGS)), np.int32)
    if len(starts):
        out[:, 0] = spans_hash(data, starts, ends) % np.uint64(BUCKETS)
        for i, n in enumerate(BEGINNINGS):
            hashes = spans_hash(data, starts, np.minimum(ends, starts + n))
            out[:, i + 1] = (hashes >> np.uint64(16 * (i + 1))) % np.uint64(BUCKETS)
    return out


@dataclass
class ToxicityModel:
    """Weights of the classifier and the thresholds of its decisions."""

    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.3
    thresholds: dict[str, float] = field(default_factory=dict)

    def products(self) -> np.ndarray:
        """What each bucket adds to each filter at each place under it."""
        parts = [self.vectors @ f[j] for f in self.filters for j in range(len(f))]
        return np.concatenate(parts, 1).astype(np.float32)

    def pooled(self, words: np.ndarray, products: np.ndarray) -> np.ndarray:
        """The highest value of each filter in a text, block by block."""
        most = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        n, wide = max(len(words), 1), max(WIDTHS)
        for at in range(0, n, BLOCK):
            own = words[at : at + BLOCK + wide - 1]
            size = min(BLOCK, n - at)
            table = np.zeros((size + wide - 1, products.shape[1]), np.float32)
            for column in own.T:
                table[: len(own)] += products[column]
            place = 0
            for i, k in enumerate(WIDTHS):
                value = np.zeros((size, FILTERS), np.float32)
                for j in range(k):
                    value += table[j : j + size, place : place + FILTERS]
                    place += FILTERS
                best = slice(i * FILTERS, (i + 1) * FILTERS)
                most[best] = np.maximum(most[best], value.max(0))
        return np.maximum(most + np.concatenate(self.biases), 0)

    def score(self, texts: list[str], products: np.ndarray | None = None) -> np.ndarray:
        """Probability of each text to be toxic."""
        products = self.products() if products is None else products
        pooled = np.array([self.pooled(buckets(t), products) for t in texts]).reshape(
            len(texts), len(self.weights)
        )
        raw = pooled @ self.weights + self.bias
        return sigmoid(self.slope * raw + self.shift)


def _batch(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with room for the widest filter; their starts."""
    gap = np.full((max(WIDTHS) - 1, 1 + len(BEGINNINGS)), BUCKETS, np.int32)
    parts, starts, at = [], [], 0
    for words in rows:
        words = words if len(words) else np.full((1, 1 + len(BEGINNINGS)), BUCKETS, np.int32)
        parts += [words, gap]
        starts.append(at)
        at += len(words) + len(gap)
    return np.concatenate(parts), np.array([*starts, at])


def _fit(rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, steps: int) -> ToxicityModel:
    vectors = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    met = np.zeros(BUCKETS + 1, np.int64)
    for words in rows:
        met[np.unique(words)] += 1
    rare = met < LEAST_TEXTS
    rare[-1] = True
    vectors[rare] = 0
    filters = [rng.normal(0, (k * DIM) ** -0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    bias = np.array([np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))], np.float32)
    learn_vectors = Adam(vectors, 0.02)
    learn = [Adam(x, 0.01) for x in (*filters, *biases, weights, bias)]
    gap = max(WIDTHS) - 1
    order = rng.permutation(len(rows))
    for step in range(steps):
        at = step * 32 % len(rows)
        if at < 32:
            order = rng.permutation(len(rows))
        chosen = order[at : at + 32]
        words, starts = _batch([rows[i] for i in chosen])
        x = vectors[words].sum(1)
        pooled, places = [], []
        for k, f, b in zip(WIDTHS, filters, biases, strict=True):
            value = np.zeros((len(x) - gap, FILTERS), np.float32)
            for j in range(k):
                value += x[j : j + len(value)] @ f[j]
            place = np.array(
                [a + value[a : e - gap].argmax(0) for a, e in zip(starts, starts[1:], strict=False)]
            )
            places.append(place)
            pooled.append(np.take_along_axis(value, place, 0) + b)
        pooled = np.concatenate(pooled, 1)
        hidden = np.maximum(pooled, 0)
        error = (sigmoid(hidden @ weights + bias[0]) - labels[chosen]).astype(np.float32) / len(chosen)
        back = (error[:, None] * weights) * (pooled > 0)
        gradients, rows_at, of_rows = [], [], []
        for i, (k, f) in enumerate(zip(WIDTHS, filters, strict=True)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            gradient = np.zeros_like(f)
            for j in range(k):
                where = places[i] + j
                gradient[j] = np.einsum("nfd,nf->df", x[where], own)
                rows_at.append(where.ravel())
                of_rows.append((own[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            gradients.append(gradient)
        gradients += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
        gradients += [hidden.T @ error, error.sum(keepdims=True)]
        for apply, gradient in zip(learn, gradients, strict=True):
            apply(gradient)
        touched = words[np.concatenate(rows_at)]
        pieces = np.repeat(np.concatenate(of_rows), touched.shape[1], 0)
        rows_hit, inverse = np.unique(touched.ravel(), return_inverse=True)
        summed = np.zeros((len(rows_hit), DIM), np.float32)
        np.add.at(summed, inverse, pieces)
        summed[rare[rows_hit]] = 0
        learn_vectors(summed, rows_hit)
    return ToxicityModel(vectors[:-1], filters, biases, weights, float(bias[0]))


def _best_threshold(toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the range with the best F2, from the rows of each score bin.

    That is F1 with recall counting twice: a toxic row that stays does more harm
    than a clean one that goes.
    """
    grid = np.arange(round(LOWEST * BINS), round(HIGHEST * BINS) + 1)
    hits, wrong = (np.array([n[t:].sum() for t in grid]) for n in (toxic, clean))
    f2 = 5 * hits / np.maximum(1, hits + wrong + 4 * toxic.sum())
    best = grid[f2 >= f2.max() - 1e-9]
    return float(best[len(best) // 2]) / BINS


def _score_counts(
    docs: DataFrame, known: DataFrame, fitted: list[int], model: ToxicityModel
) -> dict[str, np.ndarray]:
    """Labelled rows that were not fitted on: clean and toxic ones by score bin, by language.

    They are scored on Spark, all of them; what comes back are counts.
    """
    spark = docs.sparkSession
    apart = spark.createDataFrame([(i,) for i in sorted(set(fitted))], "doc_id long")
    known = known.join(F.broadcast(apart), "doc_id", "left_anti")
    known = small_side(written_table(known, new_shared_path(spark, "labelled")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", text_or_empty("text").alias("text"), lang.cast("string").alias("lang"))
    rows = rows.join(known, "doc_id").withColumn("score", toxicity_score(rows, model))
    bins = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    found: dict[str, np.ndarray] = {}
    counts = rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), bins.alias("bin"), "__label").count()
    for row in counts.collect():
        table = found.setdefault(row["lang"], np.zeros((2, BINS), np.int64))
        table[int(row["__label"] > 0), row["bin"]] += row["count"]
    return found


def train_toxicity(
    docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, held_out: int | None = 2, seed: int = 7
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows, without the fold ``held_out``.

    A fifth of the sample sets the slope of the scores. The thresholds come from
    all labelled rows outside the fitted ones, counted by language and score: one
    for each language with toxic and clean rows among them, evened out with the
    common one, which is that of the others; all lie from ``LOWEST`` to ``HIGHEST``.
    Language is used for the thresholds alone. Without labels of both kinds every
    score is the share of toxic labels.
    """
    texts, y, ids = labelled_sample(docs, labels, F.col("toxic"), most, held_out)
    rng = np.random.default_rng(seed)
    rows = [buckets(t) for t in texts]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        model = _fit([np.zeros((0, 1 + len(BEGINNINGS)), np.int32)], np.zeros(1), rng, 0)
        model.weights[:] = 0
        model.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return model
    part = rng.permutation(len(rows)) % 5 == 0
    steps = int(np.clip(len(rows) * 8 // 32, 500, 1500))
    model = _fit([r for r, p in zip(rows, part, strict=True) if not p], y[~part], rng, steps)
    products = model.products()
    pooled = np.array([model.pooled(r, products) for r, p in zip(rows, part, strict=True) if p])
    raw = pooled @ model.weights + model.bias
    truth = y[part]
    if 0 < truth.sum() < len(truth):
        target = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / (len(truth) - truth.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(500):
            error = sigmoid(a * raw + b) - target
            a -= 0.02 * (error * raw).mean() + 0.0005 * (a - 1)
            b -= 0.05 * error.mean()
        model.slope, model.shift = max(float(a), 0.1), float(b)
    fitted = [i for i, p in zip(ids, part, strict=True) if not p]
    found = _score_counts(docs, known_labels(labels, F.col("toxic"), held_out), fitted, model)
    total = sum(found.values(), np.zeros((2, BINS), np.int64))
    if total.sum(1).all():
        model.threshold = _best_threshold(total[1], total[0])
        for lang, (clean, toxic) in sorted(found.items()):
            n = int(toxic.sum())
            if lang and n and clean.any():
                own = _best_threshold(toxic, clean)
                model.thresholds[lang] = (n * own + EVENED * model.threshold) / (n + EVENED)
    return model


def toxicity_score(docs: DataFrame, model: ToxicityModel, text: Column | str = "text") -> Column:
    """Score of a whole text, 0 to 1; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.products()))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, products = shared.value
        for texts in batches:
            values = [own.score([t.as_py()], products)[0] for t in texts]
            yield pa.array(np.array(values, np.float64), pa.float64())

    return scored(text_or_empty(text))


def threshold_of(model: ToxicityModel, lang: Column | str) -> Column:
    """The threshold for a language; null and unknown ones have the common one."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    if not model.thresholds:
        return F.lit(model.threshold)
    pairs = [F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair]
    return F.coalesce(F.create_map(*pairs)[lang], F.lit(model.threshold))


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity`` and ``is_toxic`` added.

    A row is toxic if its score reaches the threshold of its language. Columns
    of these names are replaced.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.withColumn("toxicity", toxicity_score(docs, model))
    return scored.withColumn("is_toxic", F.col("toxicity") >= threshold_of(model, lang))
