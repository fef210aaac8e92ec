"""Near-duplicate embeddings by NN-descent.

Equal vectors are one node. Each node starts with a short list of random others;
its room grows with the logarithm of the table, as descent over many vectors with
lists that suit few misses pairs, and then had to go on with doubled lists.
A round joins neighbours of neighbours: around each node those on its list, and
those that have it on theirs, are compared with each other where one of the two is
new, and every node keeps the nearest it has met. A list that is full of vectors
beyond the threshold is saturated and doubles. When hardly anything changes, the
entries at the threshold are checked and kept as links, and links make groups.
All links of a vector are within its group, so the pairs of a group are then
compared exactly, in pairs of blocks of bounded size: that counts the links of groups too
large for lists. An audit compares a bounded sample of nodes with all others;
below the wanted recall all lists double, meet new random vectors and the descent
goes on. Descent steers by vectors of a byte a component; what counts is worked
out in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_shared_path, written_table
from .common import runs_of_groups, sorted_groups
from .components import components

THRESHOLD = 0.9
NEIGHBOURS = 16
"""Length of a list at first, in tables of up to ``SMALL`` distinct vectors."""
SMALL = 8_192
LONGER = 4
"""With each doubling of the table beyond that, lists are longer by so many at first."""
MOST_NEIGHBOURS = 64
"""Lists double up to this length; what they can't hold, groups do."""
ACQUAINTED = 6
"""Random groups have about so many members; each list starts from ``STARTS`` of them."""
STARTS = 3
AROUND = 64
"""So many are compared around a node, new ones first."""
OFFERED = 8
"""So many of them are offered to each."""
LEAF = 64
"""A node with more links is hot."""
BLOCK = 256
ROUNDS = 14
SETTLED = 0.01
"""Rounds end when no more than this share of the entries is new."""
AUDITED = 1_024
"""So many hot nodes, and so many others, are audited."""
RECALL = 0.98
ATTEMPTS = 3

_LISTS = "node long, near array<long>, cosine array<float>, fresh array<boolean>, most int"


def _nodes(vectors: DataFrame) -> tuple[DataFrame, np.dtype]:
    """Ids with the bytes of their vectors; null where a vector can't be compared."""
    array = vectors.schema["embedding"].dataType
    single = isinstance(array, T.ArrayType) and isinstance(array.elementType, T.FloatType)
    kind = np.dtype("<f4") if single else np.dtype("<f8")
    values = vectors.select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column("v"):
                numbers = value.as_py()
                own = None
                if numbers and None not in numbers:
                    row = np.array(numbers, kind) + kind.type(0)  # no negative zeros
                    norm = float(np.linalg.norm(row.astype(np.float64)))
                    own = row.tobytes() if np.isfinite(norm) and norm > 0 else None
                packed.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "v"])

    return values.mapInArrow(pack, "id long, v binary"), kind


def _small(column: pa.Array, kind: np.dtype) -> list[bytes]:
    """Vectors with a byte for each component, as long as a byte can say."""
    out = []
    for value in column:
        row = np.frombuffer(value.as_py(), kind).astype(np.float64)
        out.append(np.round(row * (127 / np.abs(row).max())).astype(np.int8).tobytes())
    return out


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Vectors of unit length in double precision."""
    rows = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _of_one_length(batch: pa.RecordBatch, column: str = "v") -> Iterator[pa.RecordBatch]:
    """The rows of each length of vectors."""
    lengths = pc.binary_length(batch.column(column)).to_numpy()
    kinds = np.unique(lengths)
    if len(kinds) == 1:
        yield batch
        return
    for length in kinds:
        yield batch.take(pa.array(np.flatnonzero(lengths == length)))


def _numbered(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """Distinct vectors with a number, a short form, the smallest id and how many there are.

    The numbers follow from the files of a written table, so they stay the same.
    """
    spark = rows.sparkSession
    no_id = F.lit(_NO_ID)
    distinct = rows.where("v is not null").groupBy("v").agg(
        F.min(F.coalesce("id", no_id)).alias("least"), F.count("*").alias("copies")
    )
    distinct = written_table(distinct, new_shared_path(spark, "distinct"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("small", pa.array(_small(batch.column("v"), kind), pa.binary()))

    numbered = distinct.select(F.monotonically_increasing_id().alias("node"), "v", "least", "copies")
    return numbered.mapInArrow(shorten, "node long, v binary, least long, copies long, small binary")


_NO_ID = (1 << 63) - 1


def _acquainted(nodes: DataFrame, first: int, tables: int) -> DataFrame:
    """Members (bucket, node, fresh) of random groups, ``tables`` for each node."""
    length = F.octet_length("small").alias("length")
    sizes = nodes.groupBy(length).agg(F.count("*").alias("n"))
    dealt = nodes.select("node", length, F.explode(F.sequence(F.lit(first), F.lit(first + tables - 1))).alias("t"))
    group = F.pmod(F.xxhash64("node", "t"), F.greatest(F.floor(F.col("n") / ACQUAINTED), F.lit(1)))
    return dealt.join(sizes, "length").select(
        F.xxhash64("length", "t", group).alias("bucket"), "node", F.lit(True).alias("fresh")
    )


def _around(lists: DataFrame, turn: int) -> DataFrame:
    """Members of each node's group: those on its list and those that have it on theirs.

    Of very many the new ones come first, then any, by hash; groups without new ones go.
    """
    entries = lists.select("node", F.explode(F.arrays_zip("near", "fresh")).alias("e"))
    there = entries.select(
        F.col("node").alias("bucket"), F.col("e.near").alias("node"), F.col("e.fresh").alias("fresh"), F.lit(0).alias("back")
    )
    back = entries.select(F.col("e.near").alias("bucket"), "node", F.col("e.fresh").alias("fresh"), F.lit(1).alias("back"))
    order = [F.desc("fresh"), "back", F.xxhash64("node", "bucket", F.lit(turn)), "node"]
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    chosen = there.unionByName(back).withColumn("place", place).where(F.col("place") <= AROUND)
    some = F.max("fresh").over(Window.partitionBy("bucket"))
    return chosen.withColumn("some", some).where("some").select("bucket", "node", "fresh")


def _offers(members: DataFrame, nodes: DataFrame, lists: DataFrame | None) -> DataFrame:
    """What each member of a group is offered: nearer ones than the last of its list."""
    held = nodes.select("node", "small")
    if lists is None:
        held = held.withColumn("worst", F.lit(-2.0).cast("float"))
    else:
        full = F.size("near") >= F.col("most")
        worst = F.when(full, F.array_min("cosine")).otherwise(F.lit(-2.0)).cast("float")
        held = held.join(lists.select("node", worst.alias("worst")), "node", "left")
        held = held.withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of_groups(batches, "bucket"):
            for own in _of_one_length(run, "small"):
                yield from _offers_of(own)

    return (
        members.join(held, "node")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(compare, "node long, near array<long>, cosine array<float>")
    )


def _offers_of(run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The offers in groups of vectors of one length."""
    nodes, worst = (run.column(c).to_numpy() for c in ("node", "worst"))
    fresh = run.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
    x = np.frombuffer(b"".join(run.column("small").to_pylist()), np.int8).reshape(len(nodes), -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    to, near, cosine = [], [], []
    for start, end in _bounds(run.column("bucket").to_numpy()):
        if end - start < 2:
            continue
        ids, at = np.unique(nodes[start:end], return_index=True)
        at += start
        new = fresh[at]
        if len(ids) < end - start:  # those on each other's lists come twice
            new[np.searchsorted(ids, nodes[start:end][fresh[start:end]])] = True
        cosines = x[at] @ x[at].T
        offered = (new[:, None] | new[None, :]) & (cosines > worst[at][:, None])
        np.fill_diagonal(offered, False)
        cosines = np.where(offered, cosines, -2)
        k = min(OFFERED, len(ids))
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        values = np.take_along_axis(cosines, best, 1)
        row, column = np.nonzero(values > -2)
        to.append(ids[row])
        near.append(ids[best[row, column]])
        cosine.append(values[row, column])
    if not to:
        return
    to, near, cosine = np.concatenate(to), np.concatenate(near), np.concatenate(cosine)
    order = np.argsort(to, kind="stable")
    to, near, cosine = to[order], near[order], cosine[order]
    first = np.array([start for start, _ in _bounds(to)], np.int64)
    offsets = pa.array(np.append(first, len(to)).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(to[first]),
            pa.ListArray.from_arrays(offsets, pa.array(near)),
            pa.ListArray.from_arrays(offsets, pa.array(cosine.astype(np.float32))),
        ],
        ["node", "near", "cosine"],
    )


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    ends = np.append(cuts, len(keys))
    return zip(np.concatenate([[0], cuts]), ends, strict=True) if len(keys) else iter(())


def _merged(lists: DataFrame | None, offers: DataFrame, threshold: float, most: int) -> DataFrame:
    """Lists of the nearest of each node, with what it is offered; saturated ones double."""
    new = offers.withColumns({"fresh": F.lit(None).cast("array<boolean>"), "most": F.lit(0)})
    rows = new if lists is None else lists.unionByName(new)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of_groups(batches, "node"):
            owners = run.column("node").to_numpy()
            bounds = np.array(list(_bounds(owners)), np.int64)
            sizes = np.maximum(np.maximum.reduceat(run.column("most").to_numpy(), bounds[:, 0]), most)
            lengths = run.column("near").value_lengths().to_numpy()
            number = np.repeat(np.repeat(np.arange(len(bounds)), bounds[:, 1] - bounds[:, 0]), lengths)
            known = np.repeat(run.column("fresh").is_valid().to_numpy(zero_copy_only=False), lengths)
            near, cosine = (run.column(c).flatten().to_numpy() for c in ("near", "cosine"))
            order = np.lexsort((~known, near, number))  # an entry that was there comes first
            number, near, cosine, known = number[order], near[order], cosine[order], known[order]
            once = np.append(True, (number[1:] != number[:-1]) | (near[1:] != near[:-1]))[: len(number)]
            number, near, cosine, known = number[once], near[once], cosine[once], known[once]
            order = np.lexsort((near, -cosine, number))
            number, near, cosine, known = number[order], near[order], cosine[order], known[order]
            first = np.searchsorted(number, np.arange(len(bounds)))
            kept = np.arange(len(number)) - first[number] < sizes[number]
            number, near, cosine, known = number[kept], near[kept], cosine[kept], known[kept]
            counts = np.bincount(number, minlength=len(bounds))
            last = np.cumsum(counts) - 1
            saturated = (counts == sizes) & (cosine[last] >= threshold)
            doubled = np.maximum(np.minimum(2 * sizes, MOST_NEIGHBOURS), sizes)
            sizes = np.where(saturated, doubled, sizes)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owners[bounds[:, 0]]),
                    *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (near, cosine, ~known)),
                    pa.array(sizes.astype(np.int32)),
                ],
                ["node", "near", "cosine", "fresh", "most"],
            )

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(merge, _LISTS)


def _links(lists: DataFrame, nodes: DataFrame, kind: np.dtype, threshold: float) -> DataFrame:
    """The entries at the threshold (a, b), once each, checked in double precision."""
    entries = lists.select("node", F.explode(F.arrays_zip("near", "cosine")).alias("e"))
    pairs = entries.select(
        F.least("node", "e.near").alias("a"), F.greatest("node", "e.near").alias("b"), F.col("e.cosine").alias("c")
    )
    held = nodes.select("node", "v")
    close = F.col("c") >= threshold - 0.5 * F.sqrt(F.octet_length("x") / F.lit(kind.itemsize)) / 127
    both = (
        pairs.where(F.col("c") >= threshold - 0.5)
        .groupBy("a", "b")
        .agg(F.max("c").alias("c"))
        .join(held.toDF("a", "x"), "a")
        .where(close)
        .join(held.toDF("b", "y"), "b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _of_one_length(batch, "x"):
                if own.num_rows:
                    x, y = (_matrix(own.column(c), kind) for c in ("x", "y"))
                    good = pa.array((x * y).sum(1) >= threshold)
                    yield own.select(["a", "b"]).filter(good)

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _counted(groups: DataFrame, nodes: DataFrame, kind: np.dtype, threshold: float) -> DataFrame:
    """Linked nodes (pairs) and vectors (links) of each node, from all pairs of each group.

    Each pair of blocks of a group is a group of its own, and hands on counts.
    """
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", F.lit(3)), "parts")).otherwise(F.lit(0))
    paired = groups.join(sizes, "component").select(
        "component", "node", part.cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    ).select(
        "component", "node", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )
    block = ["component", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, block):
            low, high = (group.column(c)[0].as_py() for c in ("low", "high"))
            dealt, copies = group.column("part").to_numpy(), group.column("copies").to_numpy()
            left, right = np.flatnonzero(dealt == low), np.flatnonzero(dealt == high)
            x = _matrix(group.column("v"), kind)
            linked = x[left] @ x[right].T >= threshold
            if low == high:
                np.fill_diagonal(linked, False)
            pairs, links = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            pairs[left], links[left] = linked.sum(1), linked @ copies[right]
            if low != high:
                pairs[right], links[right] = linked.sum(0), linked.T @ copies[left]
            yield pa.RecordBatch.from_arrays(
                [group.column("node"), pa.array(pairs), pa.array(links)], ["node", "pairs", "links"]
            )

    counts = (
        paired.join(nodes.select("node", "v", "copies"), "node")
        .repartition(*block)
        .sortWithinPartitions(*block)
        .mapInArrow(compare, "node long, pairs long, links long")
    )
    return counts.groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum("links").alias("links"))


def _audit(totals: DataFrame, nodes: DataFrame, kind: np.dtype, threshold: float) -> float:
    """Share of its links that a node has, on average over a bounded sample.

    Nodes count alike, however many links they have; of hot nodes and of others
    there is a sample each, and the lower average is returned.
    """
    held = nodes.select("node", "v").join(totals.select("node", "pairs"), "node", "left")
    many = F.coalesce("pairs", F.lit(0)) > LEAF
    chosen = []
    for side in (many, ~many):
        chosen += held.where(side).orderBy(F.xxhash64("node", F.lit(1)), "node").limit(AUDITED).collect()
    asked: dict[int, list] = {}
    for row in chosen:
        asked.setdefault(len(row["v"]), []).append((row["node"], bytes(row["v"])))
    sides = {
        length: (np.array([n for n, _ in own]), _matrix(pa.array([v for _, v in own], pa.binary()), kind))
        for length, own in asked.items()
    }

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for own in _of_one_length(batch.slice(at, 1024)):
                    length = len(own.column("v")[0].as_py())
                    if length not in sides:
                        continue
                    queries, q = sides[length]
                    linked = _matrix(own.column("v"), kind) @ q.T >= threshold
                    linked &= own.column("node").to_numpy()[:, None] != queries[None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries), pa.array(linked.sum(0, dtype=np.int64))], ["node", "n"]
                    )

    true = nodes.select("node", "v").mapInArrow(search, "node long, n long")
    true = true.groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")
    share = F.coalesce("pairs", F.lit(0)) / F.col("n")
    hot = F.col("n") > LEAF
    shares = true.join(totals, "node", "left").agg(F.avg(F.when(hot, share)), F.avg(F.when(~hot, share))).first()
    return min((float(s) for s in shares if s is not None), default=1.0)


def _first_length(n: int) -> int:
    """Length of a list at first: the more vectors there are, the longer lists have to be to lead to all."""
    return min(NEIGHBOURS + int(LONGER * np.log2(max(n / SMALL, 1))), max(NEIGHBOURS, MOST_NEIGHBOURS))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: links and group.

    ``vectors`` has vec_id and embedding (an array of numbers); other columns are
    left out. Two vectors are linked if their cosine is at least ``threshold``.
    Returned are vec_id, ``n_links`` (other vectors linked), ``component_id`` (the
    smallest id that links lead to, its own included) and ``kept`` (whether the
    row is that one). Vectors that are null, empty or zero, hold nulls or values
    that are not finite, or whose length is not finite, link with nothing, as do
    vectors of different dimensions with each other. Ids are taken to be
    unique; rows that repeat one count as vectors of their own, and a null id
    comes after all others. The table may be empty. The search is
    approximate: it goes on until the nodes of a bounded sample have ``RECALL`` of
    their links on average, hot ones and others; if lists doubled ``ATTEMPTS`` - 1
    times don't do, that is an error. All pairs of a group of linked vectors are
    compared, so the work for a group grows with its square.
    """
    spark = vectors.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        return written_table(df, new_shared_path(spark, label))

    packed, kind = _nodes(vectors)
    rows = written(packed, "vectors")
    nodes = written(_numbered(rows, kind), "nodes")
    lists, recall = None, 0.0
    first = _first_length(nodes.count())
    for attempt in range(ATTEMPTS):
        most = first << attempt
        offers = _offers(_acquainted(nodes, attempt * STARTS, STARTS), nodes, None)
        lists = written(_merged(lists, offers, threshold, most), "lists")
        for turn in range(ROUNDS):
            offers = _offers(_around(lists, turn), nodes, lists)
            lists = written(_merged(lists, offers, threshold, most), "lists")
            new = F.size(F.filter("fresh", lambda f: f))
            moved, total = lists.agg(F.sum(new), F.sum(F.size("near"))).first()
            if (moved or 0) <= SETTLED * (total or 0):
                break
        links = written(_links(lists, nodes, kind, threshold), "links")
        groups = written(components(links), "groups")
        totals = written(_counted(groups, nodes, kind, threshold), "totals")
        recall = _audit(totals, nodes, kind, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"links found: {recall:.4f} of those of the audited vectors, less than {RECALL}")
    groups = groups.join(nodes.select("node", "least"), "node")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    results = (
        nodes.select("node", "v", "least", "copies")
        .join(totals.select("node", "links"), "node", "left")
        .join(groups.select("node", "component"), "node", "left")
        .join(least, "component", "left")
        .select(
            "v",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    alone = F.col("v").isNull()
    group = F.when(alone, F.col("id")).otherwise(F.nullif("component_id", F.lit(_NO_ID)))
    return rows.join(results, "v", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        group.alias("component_id"),
        F.col("id").eqNullSafe(group).alias("kept"),
    )
