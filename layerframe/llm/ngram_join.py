"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts become sets of hashed shingles; equal sets are one class, joined through
one representative. MinHash bands find candidates: with 40 bands of 5 values a
pair at a similarity of 0.8 is missed once in 10 million. The members of a
bucket are compared in blocks of bounded size, each pair only in the first
bucket it shares. Within a block, MinHash values are compared some at a time,
and a pair is dropped once its posterior probability of reaching the threshold
is below a tolerance. What is left is checked exactly on the texts. Neither
candidates nor links become rows: blocks hand on lists and counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_shared_path, written_table
from .common import mix64, shingle_hashes, small_side, sorted_groups
from .components import components

THRESHOLD = 0.8
LEAST_THRESHOLD = 0.75
SHINGLE = 5
BANDS = 40
BAND_ROWS = 5
SKETCH = 96
"""So many MinHash values, a byte each, are compared for pruning."""
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256

NO_ID = (1 << 63) - 1
"""Stands for a null id while at work, so that other ids come first."""

_RNG = np.random.default_rng(20_240_229)
_FACTORS = (_RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_TERMS = _RNG.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint64).astype(np.uint32)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set of shingles."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        values = _FACTORS[:, None] * short[None, at : at + 1024] + _TERMS[:, None]
        np.minimum(out, values.min(1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each band; bands never share keys on purpose."""
    rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)
    for column in rows.T:
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def least_matches(
    compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> int:
    """Fewest matches among ``compared`` values that keep a pair.

    With an even prior, the posterior of the match rate after m of n matches is
    Beta(m + 1, n - m + 1), and its tail a binomial sum. Values are cut to a
    byte, so different ones agree once in 256.
    """
    rate = threshold + (1 - threshold) / 256
    tail, n = 0.0, compared + 1
    for m in range(compared + 1):
        tail += comb(n, m) * rate**m * (1 - rate) ** (n - m)
        if tail >= tolerance:
            return m
    return compared


def node_of(shingles: np.ndarray) -> int:
    """A number for a set of shingles: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _mark() -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    """Ids, with a last one for null, and texts in lower case."""
    return docs.select(
        _row_id().alias("id"), F.lower(F.col("text").cast("string")).alias("text"), _mark().alias("mark")
    )


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """Node, size, band keys and sketch of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands, sketches = [], [], [], []
            for value in batch.column("text"):
                shingles = shingle_hashes(value.as_py() or "", size)
                sizes.append(len(shingles))
                if not len(shingles):
                    nodes.append(None), bands.append(None), sketches.append(None)
                    continue
                values = minhashes(shingles)
                nodes.append(node_of(shingles))
                bands.append(band_keys(values))
                sketches.append((values[:SKETCH] & 0xFF).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("mark"),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["id", "mark", "node", "size", "bands", "sketch"],
            )

    return _texts(docs).mapInArrow(
        sign, "id long, mark binary, node long, size long, bands array<long>, sketch binary"
    )


def _pruned(group: pa.RecordBatch, threshold: float, cuts: list[tuple[int, int]]) -> dict | None:
    """Pairs of a block pair that survive; lists of partners by member."""
    ids = group.column("node").to_numpy()
    if len(ids) < 2:
        return None
    n = len(ids)
    parts = group.column("part").to_numpy()
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    sizes = group.column("size").to_numpy()
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint32).reshape(n, BANDS)
    sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
    band = group.column("band")[0].as_py()
    if low == high:
        a, b = np.triu_indices(n, 1)
    else:
        left, right = np.flatnonzero(parts == low), np.flatnonzero(parts == high)
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    keep = (small >= threshold * large - 1e-9) & (ids[a] != ids[b])
    a, b = a[keep], b[keep]
    for earlier in range(band):
        keep = marks[a, earlier] != marks[b, earlier]
        a, b = a[keep], b[keep]
    matches = np.zeros(len(a), np.int32)
    for at, (end, least) in zip(range(0, SKETCH, STEP), cuts, strict=True):
        if not len(a):
            return None
        matches += (sketches[a, at:end] == sketches[b, at:end]).sum(1, dtype=np.int32)
        keep = matches >= least
        a, b, matches = a[keep], b[keep], matches[keep]
    if not len(a):
        return None
    first, second = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    members = np.unique(np.concatenate([first, second]))
    starts = np.searchsorted(first, members, "left")
    ends = np.searchsorted(first, members, "right")
    return {"id": members, "partners": [second[s:e] for s, e in zip(starts, ends, strict=True)]}


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members is linked to, within a block."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row per document: links, class and group.

    ``docs`` has doc_id and text; other columns are left out. Two documents are
    linked if the Jaccard similarity of their sets of ``size``-word shingles (lower
    case; words end at ASCII white space; a shorter text is one shingle) is at
    least ``threshold``, which has to be ``LEAST_THRESHOLD`` or more: below it the
    bands would miss more than one pair in 10,000. Returned are doc_id, ``class_id`` (the smallest id
    with the same set), ``n_links`` (other documents linked), ``component_id``
    (the smallest id that links lead to) and ``kept`` (whether that is the
    document's own). Null, empty and blank texts link with nothing and are
    classes by themselves. Repeated rows count as documents, and rows of one id
    with different texts are told apart by their texts. A null id comes after all
    others; a group without any other id has null ids. The table may be empty.
    """
    rows = _joined(docs, threshold, size)
    alone = F.col("node").isNull()

    def shown(value: Column) -> Column:
        return F.when(value != NO_ID, value)

    return rows.select(
        shown(F.col("id")).alias("doc_id"),
        shown(F.when(alone, F.col("id")).otherwise(F.col("class_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        shown(F.when(alone, F.col("id")).otherwise(F.col("component_id"))).alias("component_id"),
        (alone | (F.col("id") == F.col("component_id"))).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` of which none stands for another: one of each group stays.

    Groups are those of :func:`jaccard_join`, and rows are told apart by id and text.
    The one of the smallest id stays (a null id comes last), and of several of that
    id the one whose text has the smallest digest; of rows that repeat both, one.
    Null, empty and blank texts stay. All columns are returned.
    """
    spark = docs.sparkSession
    rows = _joined(docs, threshold, size).where("node IS NOT NULL").select(
        "id", "mark", F.coalesce("component", "node").alias("group")
    )
    counted = rows.groupBy("group", "id", "mark").agg(F.count("*").alias("n"))
    counted = written_table(counted, new_shared_path(spark, "members"))
    first = counted.groupBy("group").agg(F.min(F.struct("id", "mark")).alias("first"))
    first = first.select(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    dropped = counted.select("id", "mark").join(first, ["id", "mark"], "left_anti")
    dropped = written_table(dropped, new_shared_path(spark, "dropped"))
    again = counted.where("n > 1").select("id", "mark").join(first, ["id", "mark"], "left_semi")
    again = written_table(again, new_shared_path(spark, "again"))
    key = {"__id": _row_id(), "__mark": _mark()}

    def named(keys: DataFrame) -> DataFrame:
        return small_side(keys.toDF("__id", "__mark"))

    left = docs.withColumns(key).join(named(dropped), ["__id", "__mark"], "left_anti")
    once = left.join(named(again), ["__id", "__mark"], "left_anti")
    repeated = left.join(named(again), ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def _joined(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """id, mark, node, class_id, n_links, component and component_id of every row.

    A component of several nodes is named by one of them, else it is null.
    """
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the bands are made for thresholds from {LEAST_THRESHOLD} to 1")
    spark = docs.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        return written_table(df, new_shared_path(spark, label))

    signed = written(_signed(docs, size), "signed")
    classes = signed.where("node is not null").groupBy("node").agg(
        F.min("id").alias("class_id"), F.count("*").alias("copies")
    )
    heads = signed.join(classes, "node").where("id = class_id").dropDuplicates(["node"])
    heads = written(heads.select("node", "class_id", "size", "bands", "sketch", "copies"), "heads")
    postings = heads.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = postings.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    members = postings.join(shared, "bucket").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), "parts")).otherwise(F.lit(0)).cast("int")
    )
    paired = members.select(
        "node", "band", "bucket", "part",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    ).select(
        "node", "band", "bucket", "part",
        F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
    )
    marked = heads.select(
        "node", "size", "sketch",
        F.transform("bands", lambda b: b.bitwiseAND(F.lit(0xFFFFFFFF))).alias("marks"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("marks")
            flat = marks.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).reshape(-1, BANDS)
            yield batch.set_column(
                batch.schema.get_field_index("marks"), "marks",
                pa.array([row.tobytes() for row in flat], pa.binary()),
            )

    packed = marked.mapInArrow(pack, "node long, size long, sketch binary, marks binary")
    block = ["bucket", "low", "high"]
    cuts = [(end, least_matches(end, threshold)) for end in range(STEP, SKETCH + 1, STEP)]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, block):
            out = _pruned(group, threshold, cuts)
            if out is not None:
                n = len(out["id"])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([group.column(k)[0].as_py()] * n, group.column(k).type) for k in block),
                     pa.array(out["id"]), pa.array(out["partners"], pa.list_(pa.int64()))],
                    [*block, "node", "partners"],
                )

    survivors = (
        paired.join(packed, "node")
        .repartition(*block)
        .sortWithinPartitions(*block)
        .mapInArrow(prune, "bucket long, low int, high int, node long, partners array<long>")
    )
    survivors = written(survivors, "survivors")
    chosen = heads.join(survivors.select("node").distinct(), "node").select("node", "class_id", "copies")
    chosen = written(chosen.withColumnRenamed("class_id", "id"), "chosen")
    texts = _texts(docs).join(small_side(chosen), "id")
    joined = survivors.join(texts.select("node", "copies", "text"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, block):
            text, partners = group.column("text"), group.column("partners")
            sets = [shingle_hashes(t.as_py() or "", size) for t in text]
            # A repeated id may come with other texts, and with the same one again.
            ids, order = np.unique(group.column("node").to_numpy(), return_index=True)
            own = {n: i for i, n in enumerate(map(node_of, sets))}
            order = [own[int(n)] for n in ids]
            sets = [sets[i] for i in order]
            copies = group.column("copies").to_numpy()[order]
            sizes = np.array([len(s) for s in sets])
            _, codes = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(sizes)])
            seen = np.zeros(int(codes.max()) + 1, bool)
            left, right = [], []
            for i, row in enumerate(order):
                own = np.searchsorted(ids, np.array(partners[int(row)].as_py(), np.int64))
                if not len(own):
                    continue
                seen[codes[at[i] : at[i + 1]]] = True
                common = np.array([np.count_nonzero(seen[codes[at[j] : at[j + 1]]]) for j in own])
                seen[codes[at[i] : at[i + 1]]] = False
                linked = own[common >= threshold * (sizes[i] + sizes[own] - common) - 1e-9]
                left += [i] * len(linked)
                right += linked.tolist()
            a, b = np.array(left, np.int64), np.array(right, np.int64)
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            root = ids[_roots(len(ids), a, b)]
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], ["a", "links", "b"]
            )

    checked = joined.repartition(*block).sortWithinPartitions(*block)
    checked = written(checked.mapInArrow(verify, "a long, links long, b long"), "checked")
    linked = checked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    groups = components(checked.select("a", "b")).join(classes.select("node", "class_id"), "node")
    groups = groups.select("node", "component").join(
        groups.groupBy("component").agg(F.min("class_id").alias("component_id")), "component"
    ).select("node", "component", "component_id")
    results = (
        classes.join(linked, "node", "left")
        .join(groups, "node", "left")
        .select(
            "node", "class_id", "component",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "class_id").alias("component_id"),
        )
    )
    return signed.select("id", "mark", "node").join(results, "node", "left")
