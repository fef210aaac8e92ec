"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, its
source's target over its source's size. The documents stand in a fixed order,
roughly by size, so that each stretch of the order is drawn from alike; the
expected copies are summed along it, one random offset a source is added, and a
document is emitted once for each whole number its stretch of the sum crosses.

The sums are made in two levels: documents are counted in cells of source, size
class and part of the key's hash, the cells of a source (some tens of thousands
at most, however large it is) are summed up, and documents are numbered within
their cell. So no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3.0

_CELL = ["__source", "__class", "__part"]


def word_count(text: Column | str) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_key(source: Column | str) -> Column:
    """A key that is never null and sorts by code point, null last."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def size_class(size: Column) -> Column:
    """Sizes in steps of an eighth of a power of two; sorts by size."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 3), 3, "0"))


def unit_offset(seed: str, key: Column) -> Column:
    """A number from 0 to below 1 that depends on a seed and a key only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The target of each source (columns ``__source`` and ``source_size``).

    Sources in order of their key take the weights in turn and share the sum of
    all sizes by them; a target stops at ``most`` times its source's size and
    the rest goes to the others. That is min(cap, level x weight), where the
    level is the highest of those reached by capping the sources that fill first.
    There is one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy("__source")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(in_order) - 1
    weighed = sizes.withColumn("__weight", F.element_at(turns, (rank % len(weights)) + 1)).withColumn(
        "__cap", F.col("source_size") * F.lit(float(most))
    )
    filling = everything.orderBy(F.col("__cap") / F.col("__weight"), "__source").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    left = F.sum("source_size").over(everything) - (F.sum("__cap").over(filling) - F.col("__cap"))
    open_weight = F.sum("__weight").over(everything) - (
        F.sum("__weight").over(filling) - F.col("__weight")
    )
    levelled = weighed.withColumn("__level", left / open_weight)
    level = F.max("__level").over(everything)
    return levelled.withColumn("target", F.least("__cap", level * F.col("__weight"))).select(
        "__source", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    seed: str = "mix",
    parts: int = 2,
) -> DataFrame:
    """Every document with the number of copies the mix takes.

    ``docs`` has doc_id, text and source; its columns stay, and size (words),
    source_size, target, copies and taken (copies x size) are added, in place
    of columns of those names. Null texts and texts without words have size 0;
    a null source is a source of its own. ``parts`` is the number of hexadecimal
    digits of the key's hash that split the documents of a size. A copy count
    depends on the row, the seed and the table only; equal rows are
    interchangeable. No document has more than ``most`` copies, rounded up.
    """
    if most < 1 or not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive and most at least 1")
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = (
        docs.select(*keep, word_count("text").alias("size"))
        .withColumn("__source", source_key("source"))
        .withColumn("__class", size_class(F.col("size")))
        .withColumn("__hash", hashed)
        .withColumn("__part", F.substring("__hash", 1, parts))
    )
    cells = sized.groupBy(*_CELL).agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    sizes = cells.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumn(
        "__rate",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
    )
    along = Window.partitionBy("__source").orderBy("__class", "__part")
    before = F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    placed = cells.withColumn("__before", before).drop("__n", "__words").join(targets, "__source")
    within = Window.partitionBy(*_CELL).orderBy(
        "__hash", "size", "doc_id", F.xxhash64(text_or_empty("text"))
    )
    at = F.col("__before") + F.row_number().over(within)
    offset = unit_offset(seed, F.col("__source"))
    numbered = sized.join(placed, _CELL).withColumn("__at", at)
    upto = F.floor(offset + F.col("__rate") * F.col("__at"))
    until = F.floor(offset + F.col("__rate") * (F.col("__at") - 1))
    return numbered.withColumn("copies", upto - until).select(
        *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in its own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mixed = mix(docs.select("doc_id", "text", "source", whole), **options).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.select("__row", copies.alias("__copy")).select("__row.*")
