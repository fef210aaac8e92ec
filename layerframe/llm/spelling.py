"""Spelling variants: words one edit apart, found through Bloom filters.

Words are counted over all texts. The vocabulary is put into blocked Bloom
filters, one for the words of each length, of a bounded total size, and these
are broadcast. Every word then generates its edits and probes the filter of
their length; only edits that are found there go on, to an exact join with the
vocabulary, which removes the false ones. Being near is symmetric, so a word
generates what is left of it without a character, and replacements by a
character of higher order only: each pair is generated once, from one of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshot import dereference
from ..sources.shared import new_shared_path, written_table
from .common import mix64, text_or_empty

LEAST_CHARS = 6
LEAST_COUNT = 5
TIMES = 5
"""A word's form occurs at least so many times as often."""

SHARDS = 64
"""Words of at least so many characters share a filter."""

BITS_A_WORD = 32
MOST_BLOCKS = 1 << 22
"""Blocks of 64 bits in all filters together: 32 MB at most, whatever the vocabulary.

A larger one has more false positives, so more candidates to join, and the
same result.
"""

WORDS_A_TASK = 5_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
"""In UTF-8 that has gone through ``bytes.lower``, which changes A-Z only."""

_MOST_HELD = 200_000
_MOST_BYTES = 1 << 25


def word_counts(docs: DataFrame) -> DataFrame:
    """(``word``, ``n``) of all words that are long and frequent enough.

    ``docs`` has doc_id and text. Of a run whose hash with the id is divisible by
    199 one character is left out; a null id counts as empty there, a null text
    has no runs. Each task adds up what it reads, in dictionaries of bounded size,
    before the words are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(b":" if not doc_id.is_valid else b"%d:" % doc_id.as_py())
                own = Counter(_RUN.findall(text.as_buffer().to_pybytes().lower()))
                for word, n in own.items():
                    if len(word) < LEAST_CHARS:
                        continue
                    h = zlib.crc32(word, start)
                    if h % 199 == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    if len(word) - word.count(b"\xc3") >= LEAST_CHARS:
                        found[word] += n
                        size += len(word)
            if len(found) > _MOST_HELD or size > _MOST_BYTES:
                yield _counted(found)
                found, size = Counter(), 0
        yield _counted(found)

    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = runs.mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counted(found: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(list(found.keys()), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])


_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each length: their numbers, and their code points a row."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        joined = "".join(words[i] for i in at).encode("utf-32-le")
        yield at, np.frombuffer(joined, np.uint32).reshape(len(at), length).astype(np.uint64)


class Filters:
    """A Bloom filter for the words of each length, each bit of a word in one block.

    The hash of a word is a polynomial of its code points, so that the hash of an
    edited word follows from that of the word.
    """

    def __init__(self, words_of_length: dict[int, int], most: int = MOST_BLOCKS):
        wanted = {s: n * BITS_A_WORD / 64 for s, n in words_of_length.items()}
        share = min(1.0, most / max(1.0, sum(wanted.values())))
        self.start = np.zeros(SHARDS + 2, np.uint64)
        self.blocks = np.zeros(SHARDS + 1, np.uint64)
        for shard, n in wanted.items():
            self.blocks[shard] = max(1, int(n * share))
        self.start[1:] = np.cumsum(self.blocks)
        self.bits = np.zeros(int(self.start[-1]), np.uint64)

    def places(self, hashes: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash and its bits in there."""
        mixed = mix64(hashes)
        block = ((mixed >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)
        mask = np.zeros(hashes.shape, np.uint64)
        for i in range(4):
            mask |= np.uint64(1) << ((mixed >> np.uint64(6 * i)) & np.uint64(63))
        return block + self.start[shard], mask

    def may_have(self, hashes: np.ndarray, length: int) -> np.ndarray:
        shard = min(length, SHARDS)
        if not self.blocks[shard]:
            return np.zeros(hashes.shape, bool)
        block, mask = self.places(hashes, shard)
        return (self.bits[block] & mask) == mask


def filters_of(vocabulary: DataFrame, most: int = MOST_BLOCKS) -> Filters:
    """The filters of a written vocabulary, put together by block on Spark."""
    shard = F.least(F.length("word"), F.lit(SHARDS)).alias("shard")
    filters = Filters(dict(vocabulary.groupBy(shard).count().collect()), most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _by_length(batch.column(0).to_pylist()):
                length = codes.shape[1]
                hashes = (codes * _powers(length)).sum(1)
                block, mask = filters.places(hashes, min(length, SHARDS))
                columns = [pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "mask"])

    placed = vocabulary.select("word").mapInArrow(place, "block long, mask long")
    made = placed.groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    filters.bits[made["block"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return filters


def _edits(words: list[str], filters: Filters, alphabet: np.ndarray) -> Iterator[tuple[int, str]]:
    """Number of a word and an edit of it that may be in the vocabulary."""
    for numbers, codes in _by_length(words):
        length = codes.shape[1]
        powers = _powers(length)
        terms = codes * powers
        before = np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, 1)], 1)
        whole = before[:, -1]
        for i in range(length):
            shorter = before[:, i] + (whole - before[:, i + 1]) * np.uint64(_STEP_BACK)
            hit = filters.may_have(shorter, length - 1)
            if i + 1 < length:  # of a run of the same character one is left out once
                hit &= codes[:, i] != codes[:, i + 1]
            for j in np.flatnonzero(hit):
                word = words[numbers[j]]
                yield numbers[j], word[:i] + word[i + 1 :]
            other = (whole - terms[:, i])[:, None] + alphabet * powers[i]
            row, letter = np.nonzero(alphabet > codes[:, i : i + 1])
            hit = filters.may_have(other[row, letter], length)
            for j, c in zip(row[hit], alphabet[letter[hit]], strict=True):
                word = words[numbers[j]]
                yield numbers[j], word[:i] + chr(c) + word[i + 1 :]


def near_pairs(vocabulary: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """All pairs of words one edit apart, both ways: (``word``, ``other``, ``other_n``).

    ``vocabulary`` is a written table of (word, n) with each word once.
    """
    spark = vocabulary.sparkSession
    filters = filters_of(vocabulary, most)
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    # No more than the letters that a run may have.
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint64)
    shared = spark.sparkContext.broadcast((filters, alphabet))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = (c.to_pylist() for c in batch.columns)
            found = list(_edits(words, *shared.value))
            columns = [
                pa.array([words[i] for i, _ in found], pa.string()),
                pa.array([counts[i] for i, _ in found], pa.int64()),
                pa.array([edit for _, edit in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "a_n", "b"])

    tasks = max(1, -(-vocabulary.count() // WORDS_A_TASK))
    candidates = vocabulary.repartition(tasks, "word").mapInArrow(probe, "a string, a_n long, b string")
    exact = candidates.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    return exact.select(F.inline(both))


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Words of all texts with their frequent form: one row per word.

    ``docs`` has doc_id and text; other columns are not read. Returned are word,
    n, n_near (words one edit apart), form (the most frequent of those, the smallest in
    code-point order of several, if it occurs ``TIMES`` times as often), form_n and
    root, to which the forms lead. A form occurs more often than its word, so
    they never lead round. Null and empty texts have no words, a repeated row
    counts again, an empty table has no words.
    """
    spark = docs.sparkSession
    vocabulary = written_table(word_counts(docs), new_shared_path(spark, "words"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other"))
    nears = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.minus_n") >= TIMES * F.col("n")
    formed = vocabulary.join(nears, "word", "left").select(
        "word",
        F.when(frequent, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, -F.col("best.minus_n")).alias("form_n"),
    )
    formed = written_table(formed, new_shared_path(spark, "forms"))
    ends = dereference(formed.where("form IS NOT NULL").select("word", "form"), "word", "form", check=False)
    roots = ends.select("word", F.col("target").alias("root"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
