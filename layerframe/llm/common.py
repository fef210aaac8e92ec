"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but ASCII white space."""

SLICE_CHARS = 400_000
"""About so many characters are given to a library in one call."""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def code_points(text: Column) -> Column:
    """Number of characters, as SQL counts them."""
    return F.length(text).cast("long")


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow array in lists of bounded size, with their first row.

    Null counts as empty.
    """
    part: list[str] = []
    size = first = 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if part and size + len(text) > most:
            yield first, part
            part, size, first = [], 0, i
        part.append(text)
        size += len(text)
    if part:
        yield first, part


def list_array(rows: list, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from one numpy-like sequence a row."""
    dtype = kind.to_pandas_dtype()
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    flat = np.empty(int(offsets[-1]), dtype)
    for row, at in zip(rows, offsets, strict=False):
        flat[at : at + len(row)] = row
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


_POWERS = {"at": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_BACK = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS["at"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("at", _BASE), ("back", _BASE_BACK)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["at"], _POWERS["back"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike wherever the bytes stand."""
    at, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * at[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text's bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of a text, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    starts, ends = word_spans(data)
    return spans_hash(data, starts, ends)


def shingle_hashes(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words.

    A text of fewer words has one shingle, all its words; one without words none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = mix64(total * np.uint64(5) + words[i : i + n])
    return np.unique(total)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.RecordBatch]:
    """The rows of each key from batches that are sorted by integer keys.

    Only the group at hand is held, so groups have to be of bounded size.
    """
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for column in columns:
            changed[1:] |= column[1:] != column[:-1]
        first = tuple(c[0] for c in columns)
        if rest and first != last:
            yield _joined(rest)
            rest = []
        at = 0
        for end in np.flatnonzero(changed):
            rest.append(batch.slice(at, end - at))
            yield _joined(rest)
            rest, at = [], end
        rest.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if rest:
        yield _joined(rest)


def runs_of_groups(
    batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """Batches of about ``least`` rows with whole groups of an integer key they are sorted by."""
    rest: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rest.append(batch)
        size += batch.num_rows
        if size >= least:
            whole = _joined(rest)
            keys = whole.column(key).to_numpy(zero_copy_only=False)
            end = int(np.searchsorted(keys, keys[-1], "left"))
            if end:
                yield whole.slice(0, end)
            rest = [whole.slice(end)]
            size = whole.num_rows - end
    if size:
        yield _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


MOST_BROADCAST = 1_000_000


def small_side(ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most ``most`` rows.

    Beyond that it is joined like any other table, with the same result.
    """
    return F.broadcast(ids) if ids.count() <= most else ids
