"""Documents drawn towards a target distribution, by importance and radix sort.

Features are hashed into buckets, and a bucket's gain tells how much more often
it is met in the target than in the corpus. All gains are one array of fixed
size; a document's weight is the sum of the gains of its features. Adding Gumbel
noise to the weights and taking the highest draws without replacement. Ranks
come of a distributed radix sort: from the lowest digit of the composite key to
the highest, rows are counted by block and digit, prefix sums of the counts
give each row its place, and equal digits keep their order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_shared_path, written_table

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
DIGIT_BITS = 16
LEAST_BLOCK = 4_096
MOST_BLOCK = 1 << 20
BINS = 4_096
"""Ranges of scores counted to leave out what can't be drawn before sorting."""

PIECE = 1 << 20
"""Texts are cut into words in pieces of about so many bytes."""

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
"""In UTF-8 that has gone through ``bytes.lower``, which changes A-Z only."""

_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def feature_hashes(text: bytes) -> Iterator[list[np.ndarray]]:
    """crc32 of the runs of one, two and three words, for each piece of a text.

    The hash of a run goes on from that of its beginning, so no run is put
    together; ``last`` holds those with which the piece before has ended.
    """
    data = text.lower()
    last: list[list[int]] = [[] for _ in range(LONGEST)]
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        words = _WORD.findall(data, at, end)
        at = end
        runs = [list(map(zlib.crc32, words))]
        for n in range(1, LONGEST):
            heads = last[n - 1] + runs[-1][:-1]
            follow = words[max(0, len(words) - len(heads)) :]
            runs.append([zlib.crc32(w, zlib.crc32(b" ", h)) for w, h in zip(follow, heads, strict=False)])
        last = [r[-1:] or old for r, old in zip(runs, last, strict=True)]
        yield [np.array(r, np.uint32) for r in runs]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket is met in all texts (column ``text``; null: none).

    Each task adds up its own, so as many rows as buckets leave it at most.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for runs in feature_hashes(text.as_buffer().to_pybytes()):
                        found += np.bincount(np.concatenate(runs) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    each = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(tally, "bucket long, n long")
    total = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[total["bucket"].to_numpy()] = total["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, as whole numbers."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int = 42) -> Column:
    """Noise from a hash of the id, in thousandths; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = features = weight = 0
                for runs in feature_hashes(text.as_buffer().to_pybytes()) if text.is_valid else ():
                    words += len(runs[0])
                    features += sum(map(len, runs))
                    weight += int(shared.value[np.concatenate(runs) % BUCKETS].sum())
                rows.append((words, features, weight))
            columns = np.array(rows, np.int64).reshape(len(rows), 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in columns]], ["doc_id", "n_words", "n_features", "weight"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def radix_ranks(rows: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """``rows`` with their places from 1 in the order of ``keys``.

    ``keys`` are integer columns of at least 0, the first counting most. Passes go
    over the digits from the lowest of the last key, each through a written table:
    a lost executor costs no earlier pass. A block is a range of places, so
    no task gets more rows than a block has, however many share a digit. Rows of equal
    keys follow each other in any order.
    """
    spark = rows.sparkSession
    root = new_shared_path(spark, "radix")
    known = rows.agg(F.count("*"), *[F.max(k) for k in keys]).first()
    n, tops = known[0], [int(k or 0) for k in known[1:]]
    size = min(max(LEAST_BLOCK, n // 2_000), MOST_BLOCK)
    blocks = max(1, -(-n // size))
    digits = [
        (key, shift)
        for key, top in reversed(list(zip(keys, tops, strict=True)))
        for shift in range(0, max(1, top.bit_length()), DIGIT_BITS)
    ]
    block = F.pmod(F.xxhash64(*rows.columns), F.lit(blocks))
    # No order to keep yet: any will do, if a lost task finds the same again.
    placed, order = rows.withColumn("__block", block), list(rows.columns)
    for step, (key, shift) in enumerate(digits):
        digit = F.shiftright(F.col(key), shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        dealt = placed.withColumn("__digit", digit).repartition(blocks, "__block")
        counts = dealt.groupBy("__block", "__digit").agg(F.count("*").alias("__n"))
        starts = _starts(written_table(counts, f"{root}/counts-{step}"))
        alike = Window.partitionBy("__block", "__digit").orderBy(*order)
        numbered = dealt.withColumn("__nth", F.row_number().over(alike))
        place = F.col("__start") + F.col("__nth") - 1
        moved = numbered.join(starts, ["__block", "__digit"]).select(*rows.columns, place.alias("__place"))
        moved = written_table(moved, f"{root}/{step}")
        placed = moved.withColumn("__block", F.floor(F.col("__place") / size).cast("long"))
        order = ["__place"]
    return placed.select(*rows.columns, (F.col("__place") + 1).alias(rank))


def _starts(counts: DataFrame) -> DataFrame:
    """Places before the first row of each digit in each block.

    By digit and then by block. Digits are few, so their sums are added up in
    one task; blocks of a digit follow each other within it.
    """
    digits = counts.groupBy("__digit").agg(F.sum("__n").alias("__all"))
    upwards = Window.partitionBy(F.lit(0)).orderBy("__digit")
    before = digits.select("__digit", (F.sum("__all").over(upwards) - F.col("__all")).alias("__before"))
    along = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    inside = counts.withColumn("__inside", F.sum("__n").over(along) - F.col("__n"))
    start = F.col("__before") + F.col("__inside")
    return inside.join(before, "__digit").select("__block", "__digit", start.alias("__start"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Documents of ``docs`` drawn towards the texts of ``target``: one row each.

    ``docs`` has doc_id and text, ``target`` text; other columns are not read.
    Returned are doc_id, n_features, weight, score and rank: of the documents
    with at least ``LEAST_WORDS`` words ``percent`` of a hundred, rounded down, with the
    highest scores have ranks from 1; ties go to the smaller id, a null one last.
    A null or empty text has no features and weighs 0. Rows that repeat are
    rows of their own. An empty table, or one too small to draw from, has no
    ranks.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id")))
    scored = written_table(scored, new_shared_path(spark, "weights"))
    eligible = scored.where(F.col("n_words") >= LEAST_WORDS)
    n, low, high, first, last = eligible.agg(
        F.count("*"), F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")
    ).first()
    drawn = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    width = (high - low) // BINS + 1
    bins = dict(eligible.groupBy(F.expr(f"(score - {low}L) div {width}L").alias("bin")).count().collect())
    above, least = 0, max(bins)
    for least in sorted(bins, reverse=True):
        above += bins[least]
        if above >= drawn:
            break
    can_be = (F.col("n_words") >= LEAST_WORDS) & (F.col("score") >= low + least * width)
    first = first or 0
    sortable = scored.where(can_be).select(
        *columns,
        (F.lit(high) - F.col("score")).alias("__down"),
        F.coalesce(F.col("doc_id") - F.lit(first), F.lit((last or 0) - first + 1)).alias("__up"),
    )
    ranked = radix_ranks(sortable, ["__down", "__up"])
    kept = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    rest = scored.where(~can_be).select(*columns, F.lit(None).cast("long").alias("rank"))
    return kept.unionByName(rest)
