"""Rows next to each other in the order of an id, without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

ROWS_A_BUCKET = 2_000
MOST_BUCKETS = 2_000


def with_next_text(docs: DataFrame) -> DataFrame:
    """Texts with the next one in the order of falling doc_id, in buckets.

    ``docs`` has doc_id and text (null: empty). Returned are bucket and place
    (unique together, in that order), doc_id, text, next_text, and extra: each
    bucket ends in one more row, a copy of the next bucket's first, so that what
    is derived from a row's text can be had for the next row too. After the
    last row comes the first. Null ids come last; equal ids are ordered by text.
    The result is dealt out by bucket. Buckets are ranges of the id with
    about as many rows each; their bounds are the one thing the driver learns.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    n = rows.count()
    buckets = int(min(max(n // ROWS_A_BUCKET, 1), MOST_BUCKETS))
    cuts: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 10 * MOST_BUCKETS)).first()[0]
        cuts = sorted({int(c) for c in found or []})
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<long>")
    above = F.size(F.filter(bounds, lambda c: c < F.col("doc_id")))
    rows = rows.withColumn("bucket", F.lit(len(cuts)) - F.coalesce(above, F.lit(0)))
    first = rows.groupBy("bucket").agg(F.max("doc_id").alias("__first"))
    tops = (
        rows.join(F.broadcast(first), "bucket")
        .where(F.col("doc_id").eqNullSafe(F.col("__first")))
        .groupBy("bucket", "doc_id")
        .agg(F.max("text").alias("text"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    around = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    before = F.coalesce(F.lag("bucket").over(order), F.first("bucket").over(around))
    extra = tops.withColumn("bucket", before).withColumn("extra", F.lit(True))
    everything = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    along = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("text"))
    return everything.select(
        "bucket",
        F.row_number().over(along).alias("place"),
        "doc_id",
        "text",
        F.lead("text").over(along).alias("next_text"),
        "extra",
    )
